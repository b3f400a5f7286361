"""Periodic runs of words: maximal stretches that repeat one phrase.

Runs start at Lyndon roots: if a stretch has smallest period p, then at each of its root places i the longest Lyndon
word is p words long under an order of the alphabet or under its reverse (the end of the text comes before
all words). `edges` computes, left to right and in linear time, every suffix's next smaller suffix with their common
prefix; comparisons only ever go on behind the rightmost word that a match has reached, since what lies before it is
known from the matched copy of an earlier edge. No suffix array, tree or hash takes part: words are interned to numbers
by equality, in order of appearance, and any total order will do.

A run of exponent e holds each of its words e times. So a text is first cut, exactly, at words that occur less often
between two cuts, again and again; prose falls apart by that, and what is left goes through `edges`.

Cases: null and empty texts have no words and no run; a null text stays null; a text of one repeated word is one
run; rows are independent, so repeated rows and ids have results of their own; an empty table gives no rows; other
columns are ignored by `find` and kept by `collapse`, whatever their names. White space between words becomes one space in
texts that `collapse` shortens, and only in these.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices, texts

#: Periods that a run holds at least, and its words at least.
EXPONENT, LEAST = 4, 6
#: Passes of the cut at rare words; what is left after them goes through `edges` as it is.
PASSES = 8

RUNS = "array<struct<start:long,length:long,period:long>>"


def edges(t: list[int]) -> tuple[list[int], list[int]]:
    """Each suffix's next smaller suffix (the length, if none) and how many items both share."""
    n = len(t)
    after, shared = [n] * n, [0] * n
    before, shared_before = [-1] * n, [0] * n
    stack = [0] if n else []
    # The match that reaches furthest: t[from_:reach] equals what lies `gap` earlier.
    from_, gap, reach = 0, 0, 0
    for r in range(1, n):
        child, common = -1, 0
        while stack:
            left = stack[-1]
            if child >= 0 and common != shared_before[child]:
                # Both were compared with the suffix between them: the shorter match decides.
                smaller = common < shared_before[child]
                k = common if smaller else shared_before[child]
            else:
                k, done = common, False
                if reach > r:
                    known = reach - r
                    if left >= from_:
                        a, b = left - gap, r - gap
                        copy = shared[a] if after[a] == b else shared_before[b] if before[b] == a else known
                        k, done = (copy, True) if copy < known else (max(k, known), False)
                    else:
                        k = max(k, known)
                if not done:
                    while r + k < n and t[left + k] == t[r + k]:
                        k += 1
                    if r + k >= reach:
                        from_, gap, reach = r, r - left, r + k
                smaller = r + k == n or t[r + k] < t[left + k]
            if not smaller:
                before[r], shared_before[r] = left, k
                break
            after[left], shared[left] = r, k
            stack.pop()
            child, common = left, k
        stack.append(r)
    return after, shared


def runs(t: list[int], exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least `exponent` (2 or more) periods and `least` items, by start and period."""
    found = set()
    for s in (t, [-x for x in t]):
        after, shared = edges(s)
        to, match = np.array(after, np.int64), np.array(shared, np.int64)
        period = to - np.arange(len(s))
        for i in np.flatnonzero(match > (exponent - 2) * period).tolist():
            p, k = int(period[i]), int(match[i])
            if i >= p and after[i - p] == i and shared[i - p] >= p:
                continue  # not the run's first root
            back, j = 0, i + p
            while back < i and s[i - 1 - back] == s[j - 1 - back]:
                back += 1
            if back + p + k >= max(least, exponent * p):
                found.add((i - back, back + p + k, p))
    return sorted(found, key=lambda x: (x[0], x[2]))


def stretches(codes: np.ndarray, owner: np.ndarray, exponent: int, least: int) -> Iterator[tuple[int, int]]:
    """Stretches of several texts' words in which runs can lie; `owner` tells the texts apart."""
    place, part = np.arange(len(codes)), owner.astype(np.int64)
    for _ in range(PASSES):
        if not len(place):
            return
        _, which, counts = np.unique(part * (int(codes.max()) + 1) + codes[place], return_inverse=True, return_counts=True)
        enough = counts[which] >= exponent
        kept, of = place[enough], part[enough]
        new = np.concatenate([[True], (np.diff(kept) > 1) | (np.diff(of) != 0)])[: len(kept)]
        part = np.cumsum(new) - 1
        long = np.bincount(part)[part] >= least if len(kept) else np.zeros(0, bool)
        same = len(kept) == len(place) and bool(long.all())
        place, part = kept[long], part[long]
        if same:
            break
    if len(place):
        first = np.flatnonzero(np.concatenate([[True], np.diff(part) != 0]))
        yield from zip(place[first].tolist(), (place[np.append(first[1:], len(place)) - 1] + 1).tolist(), strict=True)


def of_texts(docs: list[list[bytes]], exponent: int, least: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text's words."""
    sizes = np.array([len(d) for d in docs], np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    codes = np.fromiter((ids[w] for d in docs for w in d), np.int64, int(at[-1]))
    owner = np.repeat(np.arange(len(docs)), sizes)
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    for a, b in stretches(codes, owner, exponent, least):
        own = int(owner[a])
        out[own] += [(a - int(at[own]) + s, n, p) for s, n, p in runs(codes[a:b].tolist(), exponent, least)]
    return out


def shortened(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that a run repeats."""
    kept, at = [], 0
    for a, b in sorted((s + p, s + n) for s, n, p in found):
        kept += words[at:a]
        at = max(at, b)
    return kept + words[at:]


def mapped(rows: DataFrame, schema, exponent: int, least: int, build) -> DataFrame:
    """Runs the search over Arrow batches; build(batch, words of each text, runs of each text) makes the result."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = [d.split() for d in texts(batch.column(batch.schema.get_field_index("text")))]
            yield build(batch, words, of_texts(words, exponent, least))

    return rows.mapInArrow(step, schema)


def joined(words: list[list[bytes]], found: list[list[tuple[int, int, int]]]) -> list[str]:
    return [b" ".join(shortened(w, r)).decode() for w, r in zip(words, found, strict=True)]


def find(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(doc_id, runs, text) of every row: its runs by start and period, by word numbers from 0, and its words, joined by one
    space, without those in a run behind its first period."""

    def build(batch, words, found):
        rows = [[{"start": s, "length": n, "period": p} for s, n, p in r] for r in found]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind), pa.array(joined(words, found), pa.string())], names=["doc_id", "runs", "text"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return mapped(rows, f"doc_id long, runs {RUNS}, text string", exponent, least, build)


def collapse(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """All rows and columns; texts with runs keep each run's first period only."""

    def build(batch, words, found):
        at = batch.schema.get_field_index("text")
        old = batch.column(at)
        new = joined(words, found)
        kept = [n if r else o for n, r, o in zip(new, found, old.to_pylist(), strict=True)]
        return batch.set_column(at, batch.schema.field(at), pa.array(kept, old.type))

    return mapped(docs, docs.schema, exponent, least, build)


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by crc32 of the id, the words from one on repeat with a period.

    With h that sum and g = floor(h / 10): if h % 10 = 0, word i >= a = g % n becomes the original word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)). Other texts, and those without words, stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    text = F.col("text").cast("string")
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t-\r]+"), lambda x: x != "")
    # Bound once by a lambda: as an expression, the words would be split again for each word.
    planted = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 0)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.when(h % 10 == 0, planted), text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """Of each row of `find`: doc_id, n_runs, the run of greatest exponent (ties: smallest start, then period) and the digests of all runs and of the words kept."""
    best = F.expr("aggregate(runs, runs[0], (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    rows = found.select("*", F.when(F.size("runs") > 0, best).alias("best"))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
