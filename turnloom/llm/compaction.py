"""A plan for compacting small and dirty files.

Files of a source, in the order of their keys, join the last group or start another. That is sequential, but what a
stretch of files does to the group that is open before it is a function of that group's bytes alone: a step for each prefix of the
stretch that still fits (`Stretch`). Functions of neighbouring stretches compose, so they are combined in a tree, FAN at a
time, and the open group is then passed down the tree to all stretches at once. A function has a step only for files within the first
`limit` bytes of its stretch, however long that is.

Groups worth rewriting queue by most files, fewest bytes, smallest key. The longest prefix of the queue within a share of
its bytes is found by a search over that composite key, part by part: each step sums the bytes of at most
BUCKETS ranges of the part's values on the executors and goes on in the range where the sums exceed the share. Places in
the queue come from counts of BUCKETS ranges of keys. Last, the rows of each group and of each file that stays are dealt and
sorted, and hashed as they stream by.

The driver sees at most BUCKETS sums at a time, no task more than FAN functions or the rows of one file or group, a few at a time.

Cases: a null source or text is empty; rows without an id count as h = 0 and form a file without a block, the first of its source; rows
that share an id are ordered by their lines; files without live rows have the hash of no bytes; a queue without any bytes is
rewritten whole; an empty table gives an empty plan; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize, shared_dir

#: Live bytes that a group may have; the share of the queue's bytes (percent) that is rewritten; groups of a wave; cost of a file.
LIMIT, PERCENT, WAVE, FILE_COST = 131_072, 30, 4, 4096
#: Neighbouring file numbers (blocks) or stretches that are combined at a time; ranges of a step of the search, and of queue places.
FAN, BUCKETS = 16, 256

#: Tables of files are dealt by their keys: they grow with the input, and none is broadcast.
MERGE = "merge"

STRETCH = "total long, upto array<long>, carry array<long>, first array<long>, slot array<long>"


class Stretch:
    """What files in a row make of an open group of c bytes (limit + 1: full), by ranges of c.

    For c <= upto[j] (and above upto[j - 1]) the group open at the end has carry[j] bytes and starts at file (first[j],
    slot[j]); a carry of -1 means that all files have joined the open group, which then has c + total bytes.
    """

    def __init__(self, limit: int, total: int, steps: list[tuple[int, int, int, int]]):
        self.limit, self.total, self.steps = limit, total, []
        for step in steps:
            if self.steps and self.steps[-1][1:] == step[1:]:
                self.steps[-1] = step
            else:
                self.steps.append(step)
        self.upto = [s[0] for s in self.steps]

    @classmethod
    def of_files(cls, limit: int, files: list[tuple[int, int, int]]) -> Stretch:
        """Of (number, slot, live bytes) in order."""
        ends = starts_from(limit, files)
        steps, total = [], 0
        for (_, _, live), end in zip(files, ends, strict=True):
            # Open groups that still take what comes before, but not this file, leave it to start another.
            above = limit - total - live
            if total <= limit and (not steps or above < steps[-1][0]):
                steps.append((above, *end))
            total = min(limit + 1, total + live)
        # Each step so far counts from above its bound up to the one before.
        bounds = [limit + 1, *(s[0] for s in steps)]
        made = [(b, *s[1:]) for b, s in zip(bounds, steps, strict=False) if b >= 0]
        if total <= limit:
            made.append((bounds[-1], -1, 0, 0))
        return cls(limit, total, made[::-1])

    def apply(self, c: int, first: int, slot: int) -> tuple[int, int, int]:
        """The group open at the end, if the one before has c bytes and starts at the file."""
        _, carry, f, s = self.steps[bisect_left(self.upto, c)]
        return (c + self.total, first, slot) if carry < 0 else (carry, f, s)

    def then(self, other: Stretch) -> Stretch:
        steps = []
        for upto, carry, f, s in self.steps:
            if carry >= 0:
                steps.append((upto, *other.apply(carry, f, s)))
                continue
            for u, *rest in other.steps:
                if u >= self.total:
                    steps.append((min(upto, u - self.total), *rest))
                    if u - self.total >= upto:
                        break
        return Stretch(self.limit, min(self.limit + 1, self.total + other.total), steps)

    def row(self) -> dict:
        upto, carry, first, slot = (list(x) for x in zip(*self.steps, strict=True))
        return {"total": self.total, "upto": upto, "carry": carry, "first": first, "slot": slot}

    @classmethod
    def from_row(cls, limit: int, row: dict) -> Stretch:
        return cls(limit, row["total"], list(zip(row["upto"], row["carry"], row["first"], row["slot"], strict=True)))


def starts_from(limit: int, files: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """For each file, if it starts a group: the bytes and the start of the group that is open after the last file."""
    total = [0]
    for _, _, live in files:
        total.append(total[-1] + live)
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(files)
    end = len(files)
    for i in range(len(files) - 1, -1, -1):
        while end > i + 1 and total[end] - total[i] > limit:
            end -= 1
        # `end` is where the next group starts.
        out[i] = out[end] if end < len(files) else (min(limit + 1, total[end] - total[i]), *files[i][:2])
    return out


def grouped(limit: int, files: list[tuple[int, int, int]], c: int, first: int, slot: int) -> list[tuple[int, int]]:
    """The start of each file's group, if the group before has c bytes and starts at the file given."""
    out = []
    for number, own, live in files:
        if c + live > limit:
            c, first, slot = 0, number, own
        c += live
        out.append((first, slot))
    return out


def group_starts(files: DataFrame, limit: int = LIMIT, fan: int = FAN) -> DataFrame:
    """(source, number, slot, first, first_slot): the first file of each file's group.

    files: source (no null), number (from 0), slot, live_bytes; of few slots for a number.
    """
    spark = files.sparkSession
    folder = shared_dir(spark)

    def lists(rows: DataFrame, node: str, *columns: str) -> DataFrame:
        own = F.sort_array(F.collect_list(F.struct(*columns)))
        return rows.groupBy("source", F.floor(F.col(node) / fan).alias("node")).agg(own.alias("parts"))

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for parts in batch.column(2).to_pylist():
                if "total" not in parts[0]:
                    made = Stretch.of_files(limit, [(p["number"], p["slot"], p["live_bytes"]) for p in parts])
                else:
                    made = Stretch.from_row(limit, parts[0])
                    for p in parts[1:]:
                        made = made.then(Stretch.from_row(limit, p))
                rows.append(made.row())
            longs = pa.list_(pa.int64())
            fields = [pa.array([r["total"] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], longs) for k in ("upto", "carry", "first", "slot"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *fields], names=["source", "node", "total", "upto", "carry", "first", "slot"])

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From (source, parts, c, first, slot): what is open before each part."""
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                state = (r["c"], r["first"], r["slot"])
                for p in r["parts"]:
                    out.append((r["source"], p["node"], *state))
                    state = Stretch.from_row(limit, p).apply(*state)
            yield columns(out, ["source", "node", "c", "first", "slot"])

    def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                own = [(p["number"], p["slot"], p["live_bytes"]) for p in r["parts"]]
                for (number, slot, _), start in zip(own, grouped(limit, own, r["c"], r["first"], r["slot"]), strict=True):
                    out.append((r["source"], number, slot, *start))
            yield columns(out, ["source", "number", "slot", "first", "first_slot"])

    def columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
        each = list(zip(*rows, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(each[0], pa.string()), *(pa.array(x, pa.int64()) for x in each[1:])], names=names)

    last = files.agg(F.max("number")).first()[0] or 0
    levels = [materialize(lists(files.select("source", F.col("number").cast("long"), F.col("slot").cast("long"), F.col("live_bytes").cast("long")), "number", "number", "slot", "live_bytes"), "level0", folder)]
    last //= fan
    while last:  # until a source has one list
        made = levels[-1].select("source", "node", "parts").mapInArrow(combined, f"source string, node long, {STRETCH}")
        levels.append(materialize(lists(made, "node", "node", "total", "upto", "carry", "first", "slot"), f"level{len(levels)}", folder))
        last //= fan
    full = (F.lit(limit + 1).cast("long").alias("c"), F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("slot"))
    open_ = levels[-1].select("source", "node", *full)
    for k in range(len(levels) - 1, 0, -1):
        rows = levels[k].join(open_.hint(MERGE), ["source", "node"]).select("source", "parts", "c", "first", "slot")
        open_ = materialize(rows.mapInArrow(passed, "source string, node long, c long, first long, slot long"), f"open{k}", folder)
    rows = levels[0].join(open_.hint(MERGE), ["source", "node"]).select("source", "parts", "c", "first", "slot")
    found = materialize(rows.mapInArrow(assigned, "source string, number long, slot long, first long, first_slot long"), "starts", folder)
    discard(spark, folder, "starts")
    return found


#: The queue's order: columns, and whether the greatest comes first.
ORDER = (("n_files", True), ("bytes", False), ("source", False), ("first", False), ("first_slot", False))


def boundary(queue: DataFrame, percent: int = PERCENT) -> dict | None:
    """The key of the first group of the queue that a prefix of `percent` of its bytes has no room for; None if all fit."""
    whole = queue.agg(F.sum("bytes")).first()[0] or 0
    room, key = percent * whole // 100, {}
    if room >= whole:
        return None
    left = queue
    for column, down in ORDER:
        text = dict(queue.dtypes)[column] == "string"
        value = exceeding_text(left, column, room) if text else exceeding_number(left, column, room, down)
        key[column], room = value
        left = left.where(F.col(column) == F.lit(key[column]))
    return key


def exceeding(sums: list[tuple], room: int) -> tuple[object, int]:
    """Of (key, bytes) in order, the key at which the bytes exceed the room, and the room before it."""
    for k, n in sums:
        if n > room:
            return k, room
        room -= n
    raise AssertionError("all of it fits")


def exceeding_number(rows: DataFrame, column: str, room: int, down: bool) -> tuple[int, int]:
    """The value of the first row beyond the room, in the column's order, and the room that rows before that value leave."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while True:
        width = -(-(high - low + 1) // BUCKETS)
        part = rows.where(F.col(column).between(low, high)).groupBy(F.floor((F.col(column) - low) / F.lit(width)).alias("k")).agg(F.sum("bytes").alias("n"))
        k, room = exceeding(sorted(((r["k"], r["n"]) for r in part.collect()), reverse=down), room)
        low, high = low + k * width, min(high, low + (k + 1) * width - 1)
        if width == 1:
            return low, room


def exceeding_text(rows: DataFrame, column: str, room: int) -> tuple[str, int]:
    """The same for text in the order of its UTF-8 bytes, byte by byte."""
    prefix = ""
    name = F.hex(F.encode(F.col(column), "utf-8"))
    while True:
        part = rows.where(name.startswith(prefix)).groupBy(F.substring(name, len(prefix) + 1, 2).alias("k")).agg(F.sum("bytes").alias("n"))
        k, room = exceeding(sorted((r["k"], r["n"]) for r in part.collect()), room)
        if not k:
            return bytes.fromhex(prefix).decode(), room
        prefix += k


def before(key: dict | None) -> Column:
    """Whether a group of the queue comes before the key."""
    if key is None:
        return F.lit(True)
    out = F.lit(False)
    for column, down in reversed(ORDER):
        own, value = F.col(column), F.lit(key[column])
        out = (own > value if down else own < value) | ((own == value) & out)
    return out


def placed(groups: DataFrame, folder: str) -> DataFrame:
    """Groups of the queue with `place`, from 0: counts of ranges of keys, and the order within each range."""
    order = [F.col(c).desc() if down else F.col(c).asc() for c, down in ORDER]
    dealt = materialize(groups.repartitionByRange(BUCKETS, *order).withColumn("range_", F.spark_partition_id()), "ranges", folder)
    counts = dict(dealt.groupBy("range_").count().collect())
    ahead = np.concatenate([[0], np.cumsum([counts.get(k, 0) for k in range(max(counts, default=0) + 1)])]).tolist()
    own = F.row_number().over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn("place", (F.get(F.array(*(F.lit(n).cast("long") for n in ahead)), F.col("range_")) + own - 1).cast("long")).drop("range_")


def plan(files: DataFrame, folder: str, limit: int = LIMIT, percent: int = PERCENT, wave: int = WAVE) -> DataFrame:
    """(source, number, slot, first, first_slot, n_files, live_rows, bytes, live_bytes, cost, wave): every file, and what becomes of it.

    files: source, number, slot, bytes, live_rows, live_bytes, dirty, small, none of them null. Files of a group that is
    rewritten share its first file (first, first_slot), figures, cost and wave; others are their own, and have no cost or wave.
    """
    loose = files.where("dirty OR small")
    starts = group_starts(loose, limit)
    key = ["source", "first", "first_slot"]
    groups = loose.join(starts.hint(MERGE), ["source", "number", "slot"]).groupBy(*key).agg(
        F.count("*").alias("n_files"), F.sum("live_rows").alias("live_rows"), F.sum("bytes").alias("bytes"), F.sum("live_bytes").alias("live_bytes"), F.max("dirty").alias("dirty")
    )
    queue = materialize(groups.where("n_files >= 2 OR dirty").drop("dirty"), "queue", folder)
    chosen = placed(queue.where(before(boundary(queue, percent))), folder)
    chosen = chosen.withColumn("cost", F.col("bytes") + F.col("live_bytes") + FILE_COST * F.col("n_files")).withColumn("wave", F.floor(F.col("place") / wave)).drop("place")
    chosen = materialize(chosen, "chosen", folder)
    members = starts.join(chosen.hint(MERGE), key)
    none = F.lit(None).cast("long")
    rest = files.join(members.select("source", "number", "slot").hint(MERGE), ["source", "number", "slot"], "left_anti").select(
        "source", "number", "slot", F.col("number").alias("first"), F.col("slot").alias("first_slot"), F.lit(1).cast("long").alias("n_files"), "live_rows", "bytes", "live_bytes", none.alias("cost"), none.alias("wave")
    )
    return members.select(*rest.columns).unionByName(rest)


def hashed(rows: DataFrame) -> DataFrame:
    """(source, first, first_slot, live_sha256) of rows (source, first, first_slot, doc_id, line): a group's lines by doc_id, hashed as they stream by."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, hashlib.sha256(), []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(i) for i in range(3)]
            new = np.zeros(batch.num_rows, bool)
            for k in keys:
                new[1:] |= pc.not_equal(k.slice(1), k.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] = True
            first = np.flatnonzero(new)
            lines = batch.column(3).cast(pa.large_binary())
            offsets = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + batch.num_rows + 1]
            data = memoryview(lines.buffers()[2] or b"")
            for a, b in zip(first.tolist(), [*first[1:].tolist(), batch.num_rows], strict=True):
                own = tuple(k[a].as_py() for k in keys)
                if own != key:
                    if key is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(data[offsets[a] : offsets[b]])
            if len(done) >= 1000:
                yield rows_of(done)
                done = []
        if key is not None:
            yield rows_of([*done, (*key, state.hexdigest())])

    def rows_of(done: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["source", "first", "first_slot", "live_sha256"])

    key = ["source", "first", "first_slot"]
    dealt = rows.repartition(*key).sortWithinPartitions(*key, "doc_id", "line").select(*key, F.col("line").cast("binary"))
    return dealt.mapInArrow(step, "source string, first long, first_slot long, live_sha256 string")


def located(docs: DataFrame) -> DataFrame:
    """Rows of documents with the file that they lie in: source, block, slot, doc_id, text, whether deleted."""
    h = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0))
    doc = F.col("doc_id").cast("long")
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), doc.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), h.alias("h"))
    block = F.floor(F.col("doc_id") / 2000)
    slot = F.least(F.col("h") % 8, F.floor(F.col("h") / 8) % 8).cast("long")
    rows = rows.withColumn("block", block).withColumn("slot", slot)
    gone = F.floor(F.col("h") / 64) % 100 < 9 * F.pmod(F.col("slot") + F.coalesce("block", F.lit(0)), F.lit(8))
    return rows.withColumn("deleted", gone).drop("h")


def document_plan(docs: DataFrame) -> DataFrame:
    """The plan for documents as files of (source, block, slot), a row for each group that is rewritten and each file that stays.

    source, block, slot (of the first file), n_files, live_rows, bytes, cost, wave, live_sha256.
    """
    folder = shared_dir(docs.sparkSession)
    rows, live = located(docs), ~F.col("deleted")
    size = F.octet_length("text").cast("long")
    found = rows.groupBy("source", "block", "slot").agg(
        F.count("*").alias("rows"), F.count_if("deleted").alias("gone"), F.sum(size).alias("bytes"), F.count_if(live).alias("live_rows"), F.coalesce(F.sum(F.when(live, size)), F.lit(0)).alias("live_bytes")
    )
    found = materialize(found.withColumn("dirty", 100 * F.col("gone") >= 50 * F.col("rows")).withColumn("small", 4 * F.col("bytes") < 3 * LIMIT), "sizes", folder)
    low = found.agg(F.min("block")).first()[0] or 0
    number = lambda block: F.coalesce(block - low + 1, F.lit(0)).cast("long")
    planned = materialize(plan(found.withColumn("number", number(F.col("block"))).drop("block"), folder), "plan", folder)
    lines = rows.where(live).select("source", number(F.col("block")).alias("number"), "slot", "doc_id", F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text", F.lit("\n")).alias("line"))
    lines = lines.join(planned.select("source", "number", "slot", "first", "first_slot").hint(MERGE), ["source", "number", "slot"])
    key = ["source", "first", "first_slot"]
    digests = materialize(hashed(lines), "digests", folder)
    out = planned.where((F.col("first") == F.col("number")) & (F.col("first_slot") == F.col("slot"))).join(digests.hint(MERGE), key, "left")
    return out.select(
        "source", F.when(F.col("first") > 0, F.col("first") - 1 + low).cast("long").alias("block"), F.col("first_slot").alias("slot"), "n_files", "live_rows", "bytes", "cost", "wave",
        F.coalesce("live_sha256", F.lit(hashlib.sha256().hexdigest())).alias("live_sha256"),
    )
