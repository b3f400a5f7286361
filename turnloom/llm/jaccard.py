"""n-gram Jaccard join by grouped prefixes.

A document's set holds its distinct shingles of `width` words. Sets are ordered by a corpus-wide order
of shingles, rare ones first; two sets of similarity `percent` share a shingle among their first
n - ceil(percent n) + 1 (the prefix). Equal sets collapse to one first, then sets with equal prefix and
size to one group. Groups that share a prefix shingle are paired, and pairs are filtered by size and
by how many prefix shingles they would have to share. Filtered pairs join groups into families;
families are expanded to their members, whose whole sets are rebuilt from the texts and verified
within the family. What comes out of a family are links that span its verified components, never all
its pairs; components of these links are the result.

The order comes from a count sketch, whose counters grow with the corpus up to 2^MOST_BITS, summed over
all documents. Any order gives the same result; this one keeps frequent shingles out of prefixes. A
shingle that more than PAIRED groups have in their prefix does not pair them all but ties each to the
smallest, which makes a family as well.

A family is verified in blocks of about BLOCK sets, each set being sent once; then the blocks' components
are joined through one set of each. Only sets that are still outside their family's largest component
meet the other blocks. So copies of one text cost one sending each, however many there are, and no task
holds more than two blocks.

Cases: null, empty and wordless texts have an empty set, link with nothing and are their own
component; fewer words than a shingle's are one shingle; exact copies are one set, so ties and repeated
rows change nothing; rows of one doc_id are one document to the components, each with its own
n_shingles; a null doc_id is the last of its component, and rows without one are each a document of
their own, whose component_id is null where none in the component has an id; texts are read whole; an
empty table gives no rows; other columns are ignored by `join` and kept by `representatives`, whatever
their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, discard, free_names, materialize, shared_dir, slices, texts

#: Words of a shingle, and the similarity in percent, of the query.
WIDTH, PERCENT = 3, 90
#: Counters of the sketch: one for so many bytes of the input's files, within these bounds.
COUNTED_BYTES, LEAST_BITS, MOST_BITS, SKETCH_SLICES = 512, 20, 26, 32
PAIRED, BLOCK = 24, 512
CACHE = 300_000
#: Stands for a null doc_id: the last of all.
NO_ID = (1 << 63) - 1


class Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


hashes = Hashes()
CACHES.append(hashes.clear)


@dataclass(frozen=True)
class Rule:
    """What makes two texts alike."""

    width: int = WIDTH
    percent: int = PERCENT

    def shingles(self, doc: bytes) -> np.ndarray:
        """The document's set: sorted distinct 64-bit hashes of its shingles."""
        words = doc.lower().split()  # of bytes: ASCII letters and ASCII white space only
        n = len(words)
        if not n:
            return np.zeros(0, np.uint64)
        if n < self.width:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64)
        own = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
        out = np.full(n - self.width + 1, 0x94D049BB133111EB, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(self.width):
                out = (out ^ own[k : len(out) + k]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
            out *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique(out ^ (out >> np.uint64(32)))

    def prefix_length(self, n: int) -> int:
        """How many shingles of n, one of which any partner shares; 0 where only an equal set can be a partner."""
        short = (self.percent * n + 99) // 100  # shingles that are shared with a partner, at least
        return n - short + 1 if self.percent * (n + 1) <= 100 * n or short < n else 0

    def alike(self, small: int, large: int, shared: int) -> bool:
        return 100 * shared >= self.percent * (small + large - shared)


def counter(found: np.ndarray, bits: int) -> np.ndarray:
    return (found >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """As many counters as the input's size, as the plan estimates it, asks for."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(MOST_BITS, max(LEAST_BITS, (size // COUNTED_BYTES).bit_length()))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, text): texts of one doc_id, or of none, are told apart by the key."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def sketch(docs: DataFrame, rule: Rule) -> np.ndarray:
    """How often each counter's shingles occur in documents' sets, as levels of a logarithm."""
    bits = sketch_bits(docs)
    size = 1 << bits
    part = size // SKETCH_SLICES

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.uint32)
        for batch in slices(batches):
            found = np.concatenate([rule.shingles(d) for d in texts(batch.column(0))])
            np.add.at(total, counter(found, bits), np.uint32(1))
        if total.any():
            packed = [zlib.compress(total[i * part : (i + 1) * part].tobytes(), 1) for i in range(SKETCH_SLICES)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SKETCH_SLICES), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def summed(kind: type, level: bool):
        def add(group: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(part, np.uint64)
            for data in group["counts"]:
                total += np.frombuffer(zlib.decompress(data), kind)
            out = np.minimum(np.ceil(8 * np.log2(total + 1.0)), 255).astype(np.uint8) if level else total
            return pd.DataFrame({"part": [group["part"].iloc[0]], "counts": [zlib.compress(out.tobytes(), 1)]})

        return add

    rows = docs.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(step, "part int, counts binary")
    # Two rounds, so that no task sums more than a share of the tasks' counts.
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(32))).groupBy("part", "salt").applyInPandas(summed(np.uint32, False), "part int, counts binary")
    rows = rows.groupBy("part").applyInPandas(summed(np.uint64, True), "part int, counts binary").collect()  # SKETCH_SLICES rows
    out = np.zeros(size, np.uint8)
    for r in rows:
        out[r.part * part : (r.part + 1) * part] = np.frombuffer(zlib.decompress(r.counts), np.uint8)
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, rule: Rule) -> DataFrame:
    """(doc_id, text_key, n, digest, prefix) of every row."""
    order = docs.sparkSession.sparkContext.broadcast(counts)  # 2^MOST_BITS bytes at most
    bits = len(counts).bit_length() - 1

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, digest, prefix = [], [], []
            for doc in texts(batch.column(2)):
                found = rule.shingles(doc)
                size = len(found)
                n.append(size)
                digest.append(xxhash.xxh3_128_digest(found.tobytes()) if size else None)
                keep = rule.prefix_length(size)
                if keep:
                    weight = order.value[counter(found, bits)]
                    if keep < size:
                        first = np.argpartition(weight, keep - 1)
                        edge = weight[first[keep - 1]]
                        sure = found[weight < edge]
                        found = np.concatenate([sure, found[weight == edge][: keep - len(sure)]])
                prefix.append(np.sort(found[:keep]).view(np.int64))
            ends = np.cumsum([0] + [len(p) for p in prefix]).astype(np.int32)
            flat = pa.array(np.concatenate(prefix)) if prefix else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int32()), pa.array(digest, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["doc_id", "text_key", "n", "digest", "prefix"])

    return rows_of(docs).mapInArrow(step, "doc_id long, text_key long, n int, digest binary, prefix array<long>")


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """(node, root): each node's smallest reachable one, of edges (a, b), by alternating stars."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0", folder)
    state, k = None, 0
    while True:
        both = now.unionAll(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        k += 1
        now = materialize(small.select("e.u", "e.v").where("u <> v").distinct(), f"{name}{k}", folder)
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = new


def spanning(sets: list[np.ndarray], root: np.ndarray, sides: np.ndarray | None, rule: Rule) -> list[tuple[int, int]]:
    """Verified links, by position, that span the components of some sets, of which those of one root are known to be
    one; with sides, links across them alone are sought. `root` is brought up to date."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    vocabulary, at, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    # Rare tokens first, within each set; then its prefix.
    order = np.lexsort((at, counts[at], owner))
    place = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    in_prefix = place < np.repeat([rule.prefix_length(int(s)) for s in sizes], sizes)
    token, who = at[order][in_prefix], owner[order][in_prefix]
    by = np.argsort(token, kind="stable")
    token, who = token[by], who[by]
    starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, int)
    failed: set[tuple[int, int]] = set()
    links = []
    for posting in np.split(who, starts[1:]):
        for k in range(1, len(posting)):
            x = int(posting[k])
            before = posting[:k]
            for y in before[root[before] != root[x]][::-1].tolist():
                if root[x] == root[y] or (sides is not None and sides[x] == sides[y]):
                    continue
                key = (min(x, y), max(x, y))
                small, large = sorted((int(sizes[x]), int(sizes[y])))
                if 100 * small < rule.percent * large or key in failed:
                    continue
                if rule.alike(small, large, len(np.intersect1d(sets[x], sets[y], assume_unique=True))):
                    links.append((x, y))
                    root[root == root[y]] = root[x]
                else:
                    failed.add(key)
    return links


def joined(docs: DataFrame, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All rows (doc_id, text_key, n, digest), distinct sets (digest, doc_id and text_key of one row that
    holds it, root, and of one row of its component), and (doc_id, text_key) of rows that repeat.

    Each distinct set is a node of its own, whatever ids its rows have; ids come in at the end alone.
    """
    folder = shared_dir(docs.sparkSession)
    rows = materialize(prefixes(docs, sketch(docs, rule), rule), "prefixes", folder)
    copies = materialize(rows.groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "copies", folder)
    sets = rows.where("n > 0").groupBy("digest").agg(F.min(F.struct("doc_id", "text_key")).alias("low"), F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    # The numbers are written once, so they stay as they are.
    sets = materialize(sets.select("digest", "low.doc_id", "low.text_key", "n", "prefix", F.monotonically_increasing_id().alias("node")), "sets", folder)
    grouped = sets.where(F.size("prefix") > 0).groupBy("n", "prefix").agg(F.min("node").alias("gid"))
    groups = materialize(grouped, "groups", folder)
    members = materialize(sets.join(groups, ["n", "prefix"]).select("gid", "node", "n"), "members", folder)

    tokens = groups.select("gid", "n", F.size("prefix").alias("l"), F.explode("prefix").alias("token"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min("gid").alias("least")).where("df > 1")
    tokens = materialize(tokens.join(shared, "token"), "tokens", folder)
    few = tokens.where(F.col("df") <= PAIRED)
    many = tokens.where(F.col("df") > PAIRED)
    x, y = few.select("token", "gid", "n", "l"), few.select("token", F.col("gid").alias("gid2"), F.col("n").alias("n2"), F.col("l").alias("l2"))
    pairs = x.join(y, "token").where("gid < gid2").where(f"100 * least(n, n2) >= {rule.percent} * greatest(n, n2)")
    pairs = pairs.groupBy("gid", "gid2", "n", "n2", "l", "l2").agg(F.count("*").alias("common"))
    # Prefix shingles that such a pair must share; those of frequent shingles may not have been counted.
    hot = many.groupBy("gid").agg(F.count("*").alias("hot"))
    pairs = pairs.join(hot, "gid", "left").join(hot.select(F.col("gid").alias("gid2"), F.col("hot").alias("hot2")), "gid2", "left")
    overlap = f"(({rule.percent} * (n + n2) + {99 + rule.percent}) div {100 + rule.percent})"
    pairs = pairs.where(f"common + least(coalesce(hot, 0), coalesce(hot2, 0)) >= least(l - n + {overlap}, l2 - n2 + {overlap})")
    edges = pairs.select(F.col("gid").alias("a"), F.col("gid2").alias("b")).unionAll(many.select(F.col("gid").alias("a"), F.col("least").alias("b")))
    families = components(edges, folder, "families")
    families = families.unionAll(families.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("gid"), F.col("root").alias("family"))
    # Members of one group are a family even if the group has no partner.
    families = members.join(families, "gid", "left").select(F.coalesce("family", "gid").alias("family"), "node")
    families = materialize(families.distinct(), "members2", folder)
    sizes = families.groupBy("family").agg(F.count("*").alias("k")).where("k > 1")
    families = materialize(families.join(sizes, "family").select("node", "family", "k"), "family", folder)

    families = families.join(sets.select("node", "doc_id", "text_key"), "node")
    links = verified(docs, families, copies, folder, rule)
    # Sets of one doc_id are one document.
    several = rows.where(f"n > 0 AND doc_id <> {NO_ID}").groupBy("doc_id").agg(F.min("digest").alias("x"), F.max("digest").alias("y")).where("x < y").select("doc_id")
    several = rows.where("n > 0").join(materialize(several, "several", folder), "doc_id").join(sets.select("digest", "node"), "digest").select("doc_id", "node")
    several = materialize(several.distinct(), "several2", folder)
    least = several.groupBy("doc_id").agg(F.min("node").alias("a"))
    found = components(links.unionAll(several.join(least, "doc_id").select("a", F.col("node").alias("b"))), folder, "links")

    own = sets.select("digest", "doc_id", "text_key", "node").join(found, "node", "left")
    own = materialize(own.select("digest", "doc_id", "text_key", F.coalesce("root", "node").alias("root")), "roots", folder)
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    own = materialize(own.join(materialize(first, "firsts", folder), "root"), "own", folder)
    discard(docs.sparkSession, folder, "prefixes", "own", "copies")
    return rows.drop("prefix"), own, copies


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, sets, _ = joined(docs, Rule(width, percent))
    out = rows.join(sets.select("digest", F.col("first.doc_id").alias("component")), "digest", "left")
    # Wordless rows of a doc_id that has words in another row are in that one's component.
    bare = rows.where(f"n = 0 AND doc_id <> {NO_ID}").select("doc_id").distinct()
    named = out.where("n > 0").join(bare, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("component").alias("other"))
    worded, wordless = out.where("n > 0").select("doc_id", "n", "component"), out.where("n = 0").join(named, "doc_id", "left")
    out = worded.unionAll(wordless.select("doc_id", "n", F.coalesce("other", "doc_id")))
    none = F.lit(NO_ID)
    return out.select(F.nullif("doc_id", none).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.nullif("component", none).alias("component_id"))


def spanned(tasks: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, link) of rows (sets array of (node, root, side, tokens)): links that span the sets' components (see
    `spanning`; a side of null is no side), and, where link is false, each node's component by its least node."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            flat = batch.column(0).flatten()
            nodes = flat.field("node").to_numpy()
            order = np.argsort(nodes, kind="stable")  # so that no order of rows shows
            nodes, tokens = nodes[order], flat.field("tokens").take(pa.array(order))
            ends, values = tokens.offsets.to_numpy(), tokens.values.to_numpy().view(np.uint64)
            sets = [values[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            root, side = flat.field("root").to_numpy()[order].copy(), flat.field("side").take(pa.array(order))
            links = spanning(sets, root, None if side.null_count else side.to_numpy(), rule)
            where = np.array(links, np.int64).reshape(-1, 2)
            least = {r: int(x) for r, x in zip(root[::-1].tolist(), nodes[::-1].tolist(), strict=True)}  # nodes ascend
            a = np.concatenate([nodes[where[:, 0]], nodes])
            b = np.concatenate([nodes[where[:, 1]], np.array([least[r] for r in root.tolist()], np.int64)])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a), "b": pa.array(b), "link": pa.array(np.arange(len(a)) < len(where))})

    return tasks.select("sets").mapInArrow(step, "a long, b long, link boolean")


def verified(docs: DataFrame, families: DataFrame, copies: DataFrame, folder: str, rule: Rule) -> DataFrame:
    """(a, b): links that span the verified components of each family."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [rule.shingles(d).view(np.int64) for d in texts(batch.column(3))]
            ends = np.cumsum([0] + [len(s) for s in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["node", "family", "k", "tokens"])

    # The ids grow with the corpus: they are never broadcast, so one plan serves all sizes.
    needed = rows_of(docs).where("text IS NOT NULL").join(families.hint("merge"), ["doc_id", "text_key"]).select("node", "family", "k", "text")
    if not copies.isEmpty():  # written first, so that a row with many repeats can be split
        needed = materialize(needed, "needed", folder).dropDuplicates(["node"])
    whole = materialize(needed.mapInArrow(build, "node long, family long, k long, tokens array<long>"), "whole", folder)
    blocks = lambda n: F.expr(f"({n} + {BLOCK - 1}) div {BLOCK}")
    block = lambda node, n: F.pmod(F.xxhash64(node), F.col(n))
    none = F.lit(None).cast("int")
    held = lambda root, side: F.collect_list(F.struct("node", F.col(root).alias("root"), side.alias("side"), "tokens")).alias("sets")

    whole = whole.withColumn("n_blocks", blocks("k")).withColumn("block", block("node", "n_blocks"))
    first = materialize(spanned(whole.groupBy("family", "block").agg(held("node", none)), rule), "spanned", folder)
    links = first.where("link").select("a", "b")
    large = whole.where("n_blocks > 1")
    if large.isEmpty():
        return links

    # One set of each block's components stands for it.
    owner = first.where("NOT link").select(F.col("a").alias("node"), F.col("b").alias("part"))
    large = materialize(large.join(owner.hint("merge"), "node"), "parts", folder)
    stands = large.where("node = part")
    stands = stands.join(stands.groupBy("family").agg(F.count("*").alias("r")), "family").withColumn("s_blocks", blocks("r"))
    second = materialize(spanned(stands.groupBy("family", block("node", "s_blocks").alias("block")).agg(held("node", none)), rule), "spanned2", folder)
    links = links.unionAll(second.where("link").select("a", "b"))
    owner = second.where("NOT link").select(F.col("a").alias("part"), F.col("b").alias("root"))
    large = materialize(large.drop("block").join(owner.hint("merge"), "part"), "roots2", folder)

    # What is outside its family's largest component meets all blocks.
    sizes = large.groupBy("family", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("family").agg(F.max_by("root", F.struct("n", "root")).alias("most"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    large = large.join(materialize(most, "most", folder), "family").withColumn("o_blocks", blocks("others"))
    if large.isEmpty():
        return links
    outside = large.where("root <> most").withColumn("i", block("node", "o_blocks")).withColumn("j", F.explode(F.expr("sequence(0L, n_blocks - 1)")))
    every = large.withColumn("j", block("node", "n_blocks")).withColumn("i", F.explode(F.expr("sequence(0L, o_blocks - 1)")))
    both = outside.withColumn("side", F.lit(0)).select("family", "i", "j", "node", "root", "side", "tokens")
    both = both.unionAll(every.withColumn("side", F.lit(1)).select("family", "i", "j", "node", "root", "side", "tokens"))
    third = materialize(spanned(both.groupBy("family", "i", "j").agg(held("root", F.col("side"))), rule).where("link"), "spanned3", folder)
    return links.unionAll(third.select("a", "b"))


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """All columns of one row of each component: one of those with the smallest doc_id, if any has one.

    Rows without words are each kept. Five words and 80 percent are what near copies take by default.
    """
    rows, sets, copies = joined(docs, Rule(width, percent))
    folder = shared_dir(docs.sparkSession)
    own, key, worded = free_names(docs, 3)
    kept = sets.where("doc_id = first.doc_id AND text_key = first.text_key").select("doc_id", "text_key", F.lit(True))
    kept = kept.unionAll(rows.where("n = 0").select("doc_id", "text_key", F.lit(False)).distinct()).toDF(own, key, worded)
    kept = materialize(kept, "keep", folder)
    doc_id, text_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), F.xxhash64(F.col("text").cast("string"))
    # As above: ids grow with the corpus and are not broadcast, whatever their number here.
    out = docs.join(kept.hint("merge"), (doc_id == F.col(own)) & (text_key == F.col(key)))
    if not copies.isEmpty():  # of equal rows one stays; written first, as above
        out = materialize(out, "kept", folder)
        out = out.where(~F.col(worded)).unionAll(out.where(F.col(worded)).dropDuplicates([own, key]))
    return out.select(*(f"`{c}`" for c in docs.columns))
