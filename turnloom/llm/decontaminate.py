"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the benchmark's windows (10 consecutive words; a shorter item is one window).
For each pattern length a table gives, for every block of two words, how far the search may skip;
a block that ends some pattern selects a bucket of patterns, and comparing the words confirms.

The benchmark is taken in blocks of at most BLOCK_BYTES of text, each of whose tables are broadcast on
their own. One step passes a batch of documents along all blocks, of which a task holds one at a time,
and unites their hits. So memory is bounded however long the benchmark is, and documents are read once.

Cases: null or wordless text has no words and no hit; null or wordless items have no window; items
with a null item_id mark words but are not counted or listed; an item_id that repeats counts once;
an empty table on either side gives no hits; repeated documents give repeated rows; other columns
are ignored by `contamination` and kept by `decontaminate`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SHARDED_BYTES, SLICE_BYTES, slices, texts

#: Words of a window.
WINDOW = 10
#: Most bytes of benchmark text whose tables are broadcast at a time.
BLOCK_BYTES = 8 << 20

# A-Z become lower case; bytes outside words become spaces.
LOWER = bytes(
    (c + 32 if 65 <= c <= 90 else c) if c >= 0x80 or 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 else 32
    for c in range(256)
)


def words_of(data: bytes) -> list[bytes]:
    return data.translate(LOWER).split()


class WuManber:
    """Shift tables and buckets for patterns of one length, and what each pattern belongs to."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set[int]], length: int):
        self.m = length
        self.b = min(2, length)
        self.far = length - self.b + 1
        self.shift: dict = {}
        self.bucket: dict = {}
        for p, owners in patterns.items():
            for end in range(self.b, length + 1):
                block = p[end - 2 : end] if self.b == 2 else p[end - 1]
                self.shift[block] = min(self.shift.get(block, self.far), length - end)
            last = p[-2:] if self.b == 2 else p[-1]
            self.bucket.setdefault(last, {})[p] = tuple(owners)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(start, end, owners) of each occurrence."""
        m, far, shift, bucket, n = self.m, self.far, self.shift.get, self.bucket, len(words)
        if self.b == 2:
            i = m - 1
            while i < n:
                block = (words[i - 1], words[i])
                step = shift(block, far)
                if step:
                    i += step
                    continue
                if owners := bucket[block].get(tuple(words[i - m + 1 : i + 1])):
                    yield i - m + 1, i + 1, owners
                i += 1
        else:
            for i, w in enumerate(words):
                if w in bucket:
                    yield i, i + 1, bucket[w][(w,)]


class Automaton:
    """One block of the benchmark: a search for each length of its windows."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        by_length: dict[int, dict[tuple, set[int]]] = {}
        self.names = [name for name, _ in items]
        for k, (_, text) in enumerate(items):
            words = words_of(text)
            size = min(WINDOW, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                by_length.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(k)
        self.searches = [WuManber(p, size) for size, p in sorted(by_length.items())]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Merged word intervals inside occurrences, and the items that occur."""
        spans, owners = [], set()
        for search in self.searches:
            for a, b, own in search.search(words):
                spans.append((a, b))
                owners.update(own)
        return merged(spans), {self.names[k] for k in owners}


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def blocks(benchmark: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark's items, in lists of at most `most` bytes; the driver holds one at a time."""
    block, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    for name, text in rows.toLocalIterator():
        data = text.encode()
        if block and size + len(data) > most:
            yield block
            block, size = [], 0
        block.append((name, data))
        size += len(data)
    if block:
        yield block


class Searched:
    """The benchmark's blocks, each a broadcast of its own."""

    def __init__(self, benchmark: DataFrame):
        context = benchmark.sparkSession.sparkContext
        self.parts = []
        for block in blocks(benchmark):
            self.parts.append(context.broadcast(Automaton(block)))
            self.parts[-1].__dict__.pop("_value", None)  # the driver's copy is in a file

    def hits(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set[str | None]]]:
        """For each text its merged intervals and its items, of all blocks."""
        spans: list[list] = [[] for _ in docs]
        names: list[set] = [set() for _ in docs]
        for part in self.parts:
            search = part.value.hits
            for i, words in enumerate(docs):
                found, own = search(words)
                spans[i] += found
                names[i] |= own
            if len(self.parts) > 1:  # read again from the executor's disk when needed
                part.__dict__.pop("_value", None)
        return [merged(s) for s in spans] if len(self.parts) > 1 else spans, names

    @property
    def batch_bytes(self) -> int:
        """Bytes of text worth reading between two blocks."""
        return SLICE_BYTES if len(self.parts) < 2 else SHARDED_BYTES


def searched(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents' columns with `_words`, `_spans` (flat starts and ends, in words) and `_items`."""
    blocks_ = Searched(benchmark)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=blocks_.batch_bytes):
            words = [words_of(doc) for doc in texts(batch.column(batch.schema.get_field_index("text")))]
            spans, items = blocks_.hits(words)
            columns = [
                *batch.columns, pa.array([len(w) for w in words], pa.int64()), pa.array([[x for span in s for x in span] for s in spans], pa.list_(pa.int64())),
                pa.array([sorted(x for x in own if x is not None) for own in items], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "_words", "_spans", "_items"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "_words long, _spans array<long>, _items array<string>"])
    return docs.mapInArrow(step, schema)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items (sorted), contaminated."""
    rows = searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    hit = F.expr("aggregate(sequence(0, size(_spans) div 2 - 1), 0L, (s, i) -> s + _spans[2 * i + 1] - _spans[2 * i])")
    hit = F.when(F.size("_spans") > 0, hit).otherwise(F.lit(0).cast("long"))
    return rows.select(
        "doc_id", F.col("_words").alias("n_words"), hit.alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.col("_items").alias("items"), (F.size("_spans") > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without those that hold a window of the benchmark; columns as given."""
    names = docs.columns
    hidden = docs.select(*(F.col(f"`{c}`").alias(f"c{i}_" if c != "text" else "text") for i, c in enumerate(names)))
    rows = searched(hidden, benchmark).where(F.size("_spans") == 0)
    return rows.select(*(F.col(f"c{i}_" if c != "text" else "text").alias(c) for i, c in enumerate(names)))
