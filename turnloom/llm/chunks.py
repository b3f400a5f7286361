"""Substring dedup by content-defined chunking.

A gear rolling hash over 16 bytes runs along every whole text (UTF-8); where its top bits are zero,
and it was not so in the QUIET bytes before, a chunk ends. So cuts depend only on the bytes next to them, and text inserted elsewhere leaves them where they were. Chunks are deduplicated by 64-bit
digest: a digest that occurs twice or more, in several rows or in one, is repeated, and adjacent repeated
chunks of at least LEAST bytes in all form a repeated passage. (A lone chunk is shorter than that as a rule,
so a chance collision of digests makes no passage.) Each digest's first occurrence, by (doc_id, offset), is
kept; others can be removed.

Chunks are written once, with a number for each row. Digests are counted, with partial sums in each task;
only chunks with a repeated digest are then grouped, so hot passages cost a row for each occurrence and no
pairs are formed.

Cases: null and empty texts have no chunk; exact copies are repeated as a whole; every row is a document
of its own, also those that share a doc_id or have none (a null doc_id is the last of all, and rows of one
doc_id are ordered by their texts); texts without a cut are cut every MOST bytes; an empty table gives no
rows; other columns are ignored by `passages` and kept by `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import code_points, discard, free_names, materialize, shared_dir, slices, texts

#: A cut where the hash's top BITS bits are zero and were not in the QUIET bytes before; at least every MOST bytes.
BITS, QUIET, MOST = 4, 11, 512
#: Bytes of adjacent repeated chunks that make a passage: of 50 words, less the chunks at both ends.
LEAST = 200


def gear() -> np.ndarray:
    """256 well-mixed 16-bit numbers, by rule."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]), seed=7) & 0xFFFF for b in range(256)], np.uint16)


GEAR = gear()


def cuts(data: np.ndarray) -> np.ndarray:
    """Places before which a chunk ends; they depend on the bytes next to them alone."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):  # sums over 2, 4, 8, 16 bytes
        h[k:] += h[:-k] << np.uint16(k)
    hit = (h >> np.uint16(16 - BITS)) == 0
    hit[:15] = False
    at = np.flatnonzero(hit)
    if len(at):
        at = at[np.concatenate([[True], np.diff(at) > QUIET])]
    return at + 1


def bounds(doc: bytes) -> list[int]:
    """The offsets of a text's chunks, from 0 to its length; none lies inside a character."""
    if not doc:
        return [0]
    out = [0]
    n = len(doc)
    for c in [*cuts(np.frombuffer(doc, np.uint8)).tolist(), n]:
        while c < n and doc[c] & 0xC0 == 0x80:
            c += 1
        while c - out[-1] > MOST:
            step = out[-1] + MOST
            while doc[step] & 0xC0 == 0x80:
                step -= 1
            out.append(step)
        if c > out[-1]:
            out.append(c)
    return out


def digests(doc: bytes, at: list[int]) -> np.ndarray:
    h = xxhash.xxh3_64_intdigest
    return np.array([h(doc[a:b]) for a, b in zip(at, at[1:])], np.uint64).view(np.int64)  # noqa: B905


def numbered(docs: DataFrame, name: str = "row") -> DataFrame:
    """The rows with a number, which holds for as long as the result is written before it is used twice."""
    return docs.withColumn(name, F.monotonically_increasing_id())


def plain_rows(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): what chunks are made of."""
    return numbered(docs.select("doc_id", "text"))


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(digest, row, key, doc_id, a, b, size) of all chunks of numbered rows, by offsets in code points; `size` in
    bytes; `key` is the same for equal texts."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, starts, ends, sizes, n = [], [], [], [], []
            for doc in texts(batch.column(3)):
                at = bounds(doc)
                found.append(digests(doc, at))
                places = np.array(at, np.int64)
                sizes.append(np.diff(places))
                points = code_points(doc)
                if points is not None:
                    places = points[places]
                starts.append(places[:-1])
                ends.append(places[1:])
                n.append(len(at) - 1)
            which = pa.array(np.repeat(np.arange(len(n)), n))
            flat = [pa.array(np.concatenate(x).astype(np.int32)) for x in (starts, ends, sizes)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), *(batch.column(i).take(which) for i in range(3)), *flat], names=["digest", "row", "key", "doc_id", "a", "b", "size"])

    text = F.col("text").cast("string")
    rows = docs.select("row", F.xxhash64(text).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(step, "digest long, row long, key long, doc_id long, a int, b int, size int")


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """All chunks of numbered rows whose digest occurs again, with `kept` (it is the digest's first occurrence),
    `shared` (another row has it too) and first_doc."""
    # Sums are written before they are joined: a join whose sides both come from plain exchanges can split a hot digest.
    folder = shared_dir(docs.sparkSession)
    rows = materialize(chunk_rows(docs), "chunks", folder)
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "row", "a")
    found = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("row").alias("low"), F.max("row").alias("high"), F.min(place).alias("first"))
    found = found.where("n > 1").select("digest", (F.col("low") < F.col("high")).alias("shared"), F.col("first.row").alias("first_row"), F.col("first.a").alias("first_a"), F.col("first.doc_id").alias("first_doc"))
    out = rows.join(materialize(found, "digests", folder), "digest")
    kept = (F.col("first_row") == F.col("row")) & (F.col("first_a") == F.col("a"))
    out = materialize(out.select("row", "doc_id", "a", "b", "size", "shared", "first_doc", kept.alias("kept")), "repeated", folder)
    discard(docs.sparkSession, folder, "repeated")
    return out


def in_passages(chunks: DataFrame, least: int, within: bool) -> DataFrame:
    """The repeated chunks that lie in passages, with `island` (which of its row's passages) and `bytes` (of the passage)."""
    rows = chunks if within else chunks.where("shared")
    w = Window.partitionBy("row").orderBy("a")
    rows = rows.withColumn("island", F.sum(F.when(F.col("a") == F.lag("b").over(w), 0).otherwise(1)).over(w))
    return rows.withColumn("bytes", F.sum("size").over(Window.partitionBy("row", "island"))).where(F.col("bytes") >= least)


def passages(docs: DataFrame, least: int = LEAST, within: bool = True) -> DataFrame:
    """Repeated passages: (row, doc_id, start, end) in code points, bytes, first_doc (smallest document that
    holds one of its chunks), removable (characters whose first occurrence is elsewhere).

    Without `within`, only what several rows share counts. Rows are numbered for this result alone.
    """
    found = in_passages(repeated_chunks(plain_rows(docs)), least, within)
    return found.groupBy("row", "island").agg(
        F.first("doc_id").alias("doc_id"), F.min("a").cast("long").alias("start"), F.max("b").cast("long").alias("end"), F.first("bytes").alias("bytes"),
        F.min("first_doc").alias("first_doc"), F.sum(F.when(F.col("kept"), 0).otherwise(F.col("b") - F.col("a"))).cast("long").alias("removable"),
    ).drop("island")


def by_document(docs: DataFrame) -> DataFrame:
    """One row for each row that shares a passage with another one; its passages in order."""
    found = passages(docs, within=False).groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.count("*").alias("n_passages"), F.sum(F.col("end") - F.col("start")).alias("repeated_chars"), F.sum("removable").alias("removable_chars"),
        F.min("first_doc").alias("first_doc_id"), F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )
    return found.drop("row").withColumn("spans", F.expr("array_join(transform(spans, s -> concat(s.start, ':', s.end)), ',')"))


def deduplicate(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """All rows and columns, texts without the chunks of passages whose first occurrence is elsewhere; null text stays null."""
    columns = docs.columns
    row, cut_out = free_names(docs, 2)
    rows = materialize(numbered(docs, row), "rows")
    gone = in_passages(repeated_chunks(rows.select(F.col(row).alias("row"), "doc_id", "text")), least, True).where("NOT kept")
    gone = gone.groupBy(F.col("row").alias(row)).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias(cut_out))

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at = batch.schema.get_field_index("text")
            out = batch.column(at).to_pylist()
            for i, cut in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if cut:
                    ends = [0, *(c["b"] for c in cut)]
                    out[i] = "".join(out[i][a:b] for a, b in zip(ends, [*(c["a"] for c in cut), len(out[i])], strict=True))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, batch.schema.field(at).type)).select(columns)

    return rows.join(gone, row, "left").select(*(f"`{c}`" for c in columns), cut_out).mapInArrow(step, docs.schema)
