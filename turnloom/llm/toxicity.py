"""Toxicity by two class-conditional Kneser-Ney word models.

A text's words are whole runs of letters and digits; characters of scripts without spaces are words of their own. Each class has
a bigram model. A bigram's count is the number of texts that hold it, at any place; a word's count, as Kneser and Ney have it,
is the number of different words that it follows. Counts are discounted by DISCOUNT, and what that frees goes, with the same weight
in both classes, to the next lower order, which the classes share, tilted by the class's words:

    P(w | v, class) = (1 - b(v)) own(v, w) / own(v) + b(v) P(w | v, both) P(w, class) / P(w, both) / Z(v, class)
    P(w | v, both)  = both(v, w) / all(v) + b'(v) P(w, both)
    P(w, class)     = (1 - a) own(w) / own + a P(w, both)

where own and both are discounted counts of the class and of both together, and a, b and b' the shares that discounting frees; Z makes
the tilted part sum to 1, so each is a distribution over the words seen (b is 1 for a class without discounted counts). An
expression that is rare in both classes, word or pair, has about the same likelihood under either.

A text's evidence is the difference of its log-likelihoods under the two models per word. Each word's
difference counts beyond a margin only (below, it reflects language and topic). The margin, of MARGINS,
and a logistic curve that turns evidence into a score from 0 to 1 are fitted on a fold that the models
have not seen. Without a margin a text's few telling words drown in the noise of all others (README has figures). DISCOUNT was chosen on that fold, too. The models
are computed as tables. A pair that has no discounted count of its own in either class differs by what its word and what its
context differ, so tables hold words, contexts and the other pairs; pairs that lie within the least margin either way are left out. A task holds one shard of them after another.

Cases: null and empty texts have no evidence and get the score of evidence 0; documents without a
label, or with a null one, are not learned from; several labels of one document count as toxic if
any does; without both classes in the labels nothing is evidence and the curve gives the share of
toxic labels; a null doc_id counts as held out; ties and repeated rows get equal scores; texts are
read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shards, crc_mod, discard, materialize, shared_dir, slices, texts

#: Held out: documents whose crc32 modulo FOLDS is HELD_OUT; margin and curve are fitted on CALIBRATED.
FOLDS, HELD_OUT, CALIBRATED = 4, 2, 1
#: Chosen on the calibration fold of the tables at 0.1, of 1 to 4: the greatest area under the curve. Counts of one and two alone would give 0.9.
DISCOUNT = 2
#: Margins to choose from, in nats, the least first.
MARGINS = (1.0, 1.25, 1.5, 1.75, 2.0, 2.5, 3.0)
THRESHOLD = 0.3
#: Pairs that a counting task holds before it merges them.
HELD = 1 << 20
#: Bytes of text that are scored together at most.
MOST_BYTES = 6 << 20
#: The curve is over log(evidence + FLOOR), binned.
FLOOR, BIN = 1e-3, 0.02
#: The word before a text's first, and the one that stands for a context as a whole.
START, ANY = 1, 0

# Code points of scripts that put no spaces between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))

#: Letters of a word that are hashed one by one.
LETTERS = 64
_tables: list[np.ndarray] = []


def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form, and 0 (no part of a word), 1 (part of one) or 2 (a word of its own)."""
    if not _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        kind = np.zeros(0x110000, np.uint8)
        for c in range(0x20000):
            s = chr(c)
            if s.isalnum() or unicodedata.category(s)[0] == "M":
                kind[c] = 1
                if len(t := s.lower()) == 1:
                    low[c] = ord(t)
        for a, b in UNSPACED:
            kind[a : b + 1] = np.where(kind[a : b + 1] | (a >= 0x20000), 2, 0)
        _tables.extend([low, kind])
    return _tables[0], _tables[1]


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ x) * np.uint64(0x9E3779B97F4A7C15)
        return h ^ (h >> np.uint64(29))


def words(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit hashes (never ANY or START) of all texts' words in a row, and the text of each."""
    low, kind = tables()
    decoded = [d.decode() for d in docs]
    points = np.frombuffer(("\n".join(decoded) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(d) + 1 for d in decoded])
    kinds = kind[points]
    before = np.concatenate([np.zeros(1, np.uint8), kinds[:-1]])
    starts = np.flatnonzero((kinds == 2) | ((kinds == 1) & (before != 1)))
    # Letters of each word: up to where it ends or another starts.
    stops = np.flatnonzero((kinds != 1) & (before == 1))
    sizes = np.where(kinds[starts] == 2, 1, stops[np.minimum(np.searchsorted(stops, starts, side="right"), len(stops) - 1)] - starts) if len(stops) else np.ones(len(starts), np.int64)
    # A letter of all words at a time, for those that have as many; the rest of endless ones in one go.
    h = np.full(len(starts), 0x51ED270B, np.uint64)
    left = np.arange(len(starts))
    for k in range(LETTERS):
        left = left[sizes[left] > k]
        if not len(left):
            break
        h[left] = mixed(h[left], low[points[starts[left] + k]].astype(np.uint64))
    for i in left[sizes[left] > LETTERS].tolist():
        h[i] = mixed(h[i], np.uint64(xxhash.xxh3_64_intdigest(low[points[starts[i] + LETTERS : starts[i] + sizes[i]]].tobytes())))
    return np.maximum(h >> np.uint64(32), START + 1), np.searchsorted(ends, starts, side="right")


def pairs_of(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word before, word) as 64 bits, at every place; the text of each."""
    own, owner = words(docs)
    before = np.concatenate([np.full(1, START, np.uint64), own[:-1]])
    before[np.concatenate([np.ones(min(1, len(owner)), bool), owner[1:] != owner[:-1]])] = START
    return before[: len(own)] << np.uint64(32) | own, owner


def united(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, the rows of their counts added up."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts, first, axis=0) if len(keys) else counts


def counted(rows: DataFrame) -> DataFrame:
    """(pair, kt, ko): in how many toxic and in how many ordinary texts each pair of words occurs."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            keys, counts = united(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            held.clear()
            for at in range(0, len(keys), 1 << 17):
                part = counts[at : at + (1 << 17)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at : at + (1 << 17)].view(np.int64)), pa.array(part[:, 0].copy()), pa.array(part[:, 1].copy())], names=["pair", "kt", "ko"])

        for batch in slices(batches):
            pairs, owner = pairs_of(texts(batch.column(1)))
            order = np.lexsort((pairs, owner))
            pairs, owner = pairs[order], owner[order]
            new = np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (owner[1:] != owner[:-1])])[: len(pairs)]
            toxic = np.array(batch.column(0).to_pylist(), bool)[owner[new]]
            held.append(united(pairs[new], np.stack([toxic, ~toxic], axis=1).astype(np.int64)))
            if sum(len(k) for k, _ in held) > HELD:
                yield from out()
        if held:
            yield from out()

    found = rows.select("toxic", "text").mapInArrow(step, "pair long, kt long, ko long")
    return found.groupBy("pair").agg(F.sum("kt").alias("kt"), F.sum("ko").alias("ko"))


def over(column) -> F.Column:
    """A count beyond the discount."""
    return F.greatest(column - DISCOUNT, F.lit(0)).cast("double")


def gains(rows: DataFrame, folder: str) -> DataFrame:
    """(key, gain): differences of log-likelihoods: of a word (32 bits), of a context (64 bits, of ANY word), and of pairs with a count of their own."""
    pairs = materialize(counted(rows), "pairs", folder)
    after, before = F.col("pair").bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned("pair", 32)
    words = pairs.groupBy(after.alias("w")).agg(F.sum((F.col("kt") > 0).cast("long")).alias("ut"), F.sum((F.col("ko") > 0).cast("long")).alias("uo"))
    words = materialize(words, "words", folder)
    total = words.agg(F.sum(F.col("ut") + F.col("uo")), F.sum(over(F.col("ut"))), F.sum(over(F.col("uo"))), F.sum(F.least("ut", F.lit(DISCOUNT)) + F.least("uo", F.lit(DISCOUNT))), F.sum("ut"), F.sum("uo")).first()
    every, own_t, own_o, freed, ut, uo = [x or 0 for x in total]
    if not ut or not uo:  # a class without words
        return words.select(F.col("w").alias("key"), F.lit(0.0).alias("gain")).where("key < 0")
    a, both = freed / every, (F.col("ut") + F.col("uo")) / every

    def tilt(count: str, own: float):
        """A class's likelihood of a word over that of both."""
        return (1 - a) * over(F.col(count)) / own / both + a if own else F.lit(1.0)

    words = materialize(words.select("w", both.alias("both"), tilt("ut", own_t).alias("rt"), tilt("uo", own_o).alias("ro")), "likely", folder)
    single = F.log("rt") - F.log("ro")

    n = F.col("kt") + F.col("ko")
    told = pairs.withColumn("v", before).withColumn("w", after).join(words.hint("merge"), "w")
    contexts = told.groupBy("v").agg(
        F.sum(n).alias("seen"), F.sum(over(n)).alias("kept"), F.sum(over(F.col("kt"))).alias("own_t"), F.sum(over(F.col("ko"))).alias("own_o"),
        F.sum(over(n) * F.col("rt")).alias("zt"), F.sum(over(n) * F.col("ro")).alias("zo"),
    ).where("kept > 0")
    rest = 1 - F.col("kept") / F.col("seen")
    contexts = contexts.select("v", "seen", "own_t", "own_o", rest.alias("b"), (F.col("zt") / F.col("seen") + rest).alias("zt"), (F.col("zo") / F.col("seen") + rest).alias("zo"))

    def lower(own: str, z: str):
        """What a class gives to the lower order in a context, over what that sums to."""
        return F.when(F.col(own) > 0, F.col("b")).otherwise(1.0) / F.col(z)

    contexts = materialize(contexts.withColumn("lt", lower("own_t", "zt")).withColumn("lo", lower("own_o", "zo")).withColumn("about", F.log("lt") - F.log("lo")), "contexts", folder)

    rich = told.where((F.col("kt") > DISCOUNT) | (F.col("ko") > DISCOUNT)).join(contexts.hint("merge"), "v")
    shared = over(n) / F.col("seen") + F.col("b") * F.col("both")

    def pair(count: str, own: str, r: str, share: str):
        return F.log(F.when(F.col(own) > 0, (1 - F.col("b")) * over(F.col(count)) / F.col(own)).otherwise(0.0) + F.col(share) * shared * F.col(r))

    rich = rich.select(F.col("pair").alias("key"), (pair("kt", "own_t", "rt", "lt") - pair("ko", "own_o", "ro", "lo")).alias("gain"), (single + F.col("about")).alias("without"))
    # A pair within the margin matters only where its word and context alone would count.
    rich = rich.where(f"abs(gain) > {MARGINS[0]} OR abs(without) > {MARGINS[0]}").select("key", "gain")
    context = F.shiftleft("v", 32).alias("key")
    return rich.unionByName(words.select(F.col("w").alias("key"), single.alias("gain"))).unionByName(contexts.select(context, F.col("about").alias("gain")))


class Models:
    """The differences of log-likelihoods by word, by context and by pair, in one table."""

    def __init__(self, rows: DataFrame):
        self.table = Shards(rows, ["gain"], rows.count(), np.float64)

    def differences(self, docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each word's difference, 0 for those without weight; the text of each."""
        pairs, owner = pairs_of(docs)
        out = np.zeros(len(pairs))
        alone = np.ones(len(pairs), bool)
        for at, gain in self.table.find(pairs):
            out[at] = gain[:, 0]
            alone[at] = False
        left = np.flatnonzero(alone)
        known = np.zeros(len(left), bool)
        for at, gain in self.table.find(pairs[left] & np.uint64(0xFFFFFFFF)):
            out[left[at]] = gain[:, 0]
            known[at] = True
        left = left[known]  # a word that no model knows says nothing
        for at, gain in self.table.find(pairs[left] >> np.uint64(32) << np.uint64(32)):
            out[left[at]] += gain[:, 0]
        return out, owner

    def evidence(self, docs: list[bytes], margins: tuple[float, ...]) -> np.ndarray:
        """Per text, and for each margin, the difference of its log-likelihoods per word."""
        value, owner = self.differences(docs)
        sizes = np.maximum(np.bincount(owner, minlength=len(docs)), 1)
        kept = [np.sign(value) * np.maximum(np.abs(value) - m, 0) for m in margins]
        return np.stack([np.bincount(owner, x, len(docs)) / sizes for x in kept], axis=1)


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(fold, toxic, text) of labelled documents outside the held-out fold.

    Labels grow with the corpus: they are never broadcast, so one plan serves all sizes.
    """
    labels = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), crc_mod("doc_id", FOLDS).alias("fold"))
    return rows.where((F.col("fold") != HELD_OUT) & F.col("text").isNotNull()).join(labels.hint("merge"), "doc_id").select("fold", "toxic", "text")


def height(evidence: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(evidence, 0) + FLOOR) - np.log(FLOOR)


def curve(bins: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """(log-likelihood, slope, offset) of the logistic curve of binned evidence."""
    z = np.stack([bins * BIN, np.ones(len(bins))], axis=1)
    w = np.zeros(2)
    for _ in range(60):  # Newton's method with a little ridge
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (n * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2), z.T @ (n * (toxic - p)) - 1e-3 * w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slope, offset = max(float(w[0]), 0.0), float(w[1])
    p = np.clip(1 / (1 + np.exp(-(z[:, 0] * slope + offset))), 1e-12, 1 - 1e-12)
    return float((n * (toxic * np.log(p) + (1 - toxic) * np.log(1 - p))).sum()), slope, offset


def fit_curve(rows: DataFrame, models: Models) -> tuple[float, float, float]:
    """(margin, slope, offset): those under which the labels of all rows are likeliest."""
    shared = rows.sparkSession.sparkContext.broadcast(models)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, most=min(own.table.batch_bytes, MOST_BYTES)):
            at = np.round(height(own.evidence(texts(batch.column(1)), MARGINS)) / BIN).astype(np.int64)
            toxic = np.array(batch.column(0).to_pylist(), np.int64)
            each = np.stack([np.tile(np.arange(len(MARGINS)), len(toxic)), at.ravel(), np.repeat(toxic, len(MARGINS))])
            found, n = np.unique(each, axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(n.astype(np.int64))], names=["margin", "bin", "toxic", "n"])

    found = rows.select("toxic", "text").mapInArrow(step, "margin long, bin long, toxic long, n long").groupBy("margin", "bin", "toxic").agg(F.sum("n").alias("n"))
    found = np.array([tuple(r) for r in found.collect()], float).reshape(-1, 4)  # a row for each margin, bin and class
    if not len(found):
        return MARGINS[0], 0.0, -20.0
    fits = [(curve(*found[found[:, 0] == k][:, 1:].T), m) for k, m in enumerate(MARGINS)]
    (_, slope, offset), margin = max(fits, key=lambda x: x[0][0])
    return margin, slope, offset


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Models, tuple[float, float, float]]:
    """The models; the margin, and the curve's slope and offset."""
    folder = shared_dir(docs.sparkSession)
    rows = labelled(docs, labels)
    models = Models(materialize(gains(rows.where(F.col("fold") != CALIBRATED), folder), "gains", folder))
    discard(docs.sparkSession, folder)
    return models, fit_curve(rows.where(F.col("fold") == CALIBRATED), models)


def predict(docs: DataFrame, models: Models, fitted: tuple[float, float, float]) -> DataFrame:
    """Per row of (doc_id, text): score, predicted, evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    margin, slope, offset = fitted

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, most=min(own.table.batch_bytes, MOST_BYTES)):
            evidence = own.evidence(texts(batch.column(1)), (margin,))[:, 0]
            score = 1 / (1 + np.exp(-np.clip(slope * height(evidence) + offset, -700, 700)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(evidence)],
                names=["doc_id", "score", "predicted", "evidence"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(step, "doc_id long, score double, predicted int, evidence double")


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labels outside the held-out fold and scores every row."""
    out = predict(docs, *fit(docs, labels))
    held = F.coalesce(crc_mod("doc_id", FOLDS) == HELD_OUT, F.lit(True))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "evidence")
