"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python step holds expanded at a time.
SLICE_BYTES = 4 << 20
#: Spark's bound on the bytes of an Arrow batch, and what operators set it to.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares (`spark.checkpoint.dir`).

    Where the setting is missing, only a local session gets a temporary folder: on a cluster
    other machines could not see it. The session's Arrow batches are bounded by bytes as well: texts may be
    long, and the number of rows bounds no memory.
    """
    spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="turnloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/turnloom/{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(at)
    fs.deleteOnExit(at)
    return path


def materialize(df: DataFrame, name: str, folder: str | None = None, compression: str = "snappy") -> DataFrame:
    """Writes a table to the shared folder and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{folder or shared_dir(spark)}/{name}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folder: str, *kept: str) -> None:
    """Deletes the tables of a folder that no result reads, all but those named."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for found in fs.listStatus(at) if fs.exists(at) else ():
        if found.getPath().getName() not in kept:
            fs.delete(found.getPath(), True)


#: How workers empty what they keep between batches.
CACHES: list[Callable[[], None]] = []


def at_rest() -> None:
    """Gives back memory when a task has read its last batch, as idle workers stay beside those of later stages."""
    for clear in CACHES:
        clear()
    pa.default_memory_pool().release_unused()
    if hasattr(trim := ctypes.CDLL(None), "malloc_trim"):
        trim.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that each holds about `most` bytes of `column`, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.cumsum(value_sizes(batch.column(batch.schema.get_field_index(column))))
        at = 0
        while at < n:
            base = int(sizes[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
    at_rest()


def value_sizes(array: pa.Array) -> np.ndarray:
    """Bytes of each value of a string or binary column; null is 0."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(array), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def texts(array: pa.Array) -> list[bytes]:
    """The column's UTF-8 bytes; null is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(array.type) else pa.binary()
    return [x or b"" for x in array.cast(kind).to_pylist()]


def map_batches(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(step, schema)


def code_points(data: bytes) -> np.ndarray | None:
    """Maps each byte offset (and the end) to its code point offset; None if they are the same."""
    if data.isascii():
        return None
    lead = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=out[1:])
    out[:-1] = out[1:] - lead  # a byte's offset counts the characters before its own
    out[:-1][~lead] -= 1
    return out


def free_names(df: DataFrame, n: int) -> list[str]:
    """Names of columns that a table does not have."""
    names = (f"own_{i}" for i in count())
    return list(islice((x for x in names if x not in {c.lower() for c in df.columns}), n))


def crc_mod(column: str, n: int):
    """crc32 of the key as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


#: Most entries of a table that a task holds at a time.
SHARD = 1 << 21
#: Bytes of text that go through all shards together, where there are several.
SHARDED_BYTES = 16 << 20


class HashArray:
    """Values by 64-bit key, in an array sorted by the keys' hashes (a bijection, so keys stay apart)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        hashes = self.hash(keys)
        order = np.argsort(hashes)
        self.values = values[order]
        self.hashes = np.append(hashes[order], np.uint64(0xFFFFFFFFFFFFFFFF))
        self.bits = max(1, int(len(keys)).bit_length())
        counts = np.bincount((self.hashes[:-1] >> np.uint64(64 - self.bits)).astype(np.int64), minlength=1 << self.bits)
        self.starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)

    @staticmethod
    def hash(keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            h = keys * np.uint64(0x9E3779B97F4A7C15)
            return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place, and whether it is there."""
        h = self.hash(keys)
        at = self.starts[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        behind = np.flatnonzero(self.hashes[at] < h)
        while len(behind):
            at[behind] += 1
            behind = behind[self.hashes[at[behind]] < h[behind]]
        there = (self.hashes[at] == h) & (at < len(self.values))
        return np.where(there, at, 0), there


class Shards:
    """A table of any size by 64-bit key, broadcast in shards of about SHARD entries; a task holds one at a time.

    The driver holds one shard at a time as well: `rows` has a long column `key` and `columns`, and `n` rows at most.
    """

    def __init__(self, rows: DataFrame, columns: list[str], n: int, kind=np.float32):
        self.n = max(1, -(-n // SHARD))
        context = rows.sparkSession.sparkContext
        self.parts = []
        for k in range(self.n):
            own = (rows if self.n == 1 else rows.where(F.pmod("key", F.lit(self.n)) == k)).select("key", *columns).toArrow()
            values = np.stack([own[c].to_numpy().astype(kind) for c in columns], axis=1) if columns else np.zeros((len(own), 0), kind)
            self.parts.append(context.broadcast(HashArray(own["key"].to_numpy().view(np.uint64), values)))
            self.parts[-1].__dict__.pop("_value", None)  # the driver's copy is in a file

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each shard the indices of the keys that it holds, ascending, and their values."""
        shard = (keys.view(np.int64) % self.n) if self.n > 1 else None
        for k, part in enumerate(self.parts):
            own = np.flatnonzero(shard == k) if self.n > 1 else slice(None)
            table = part.value
            at, there = table.find(keys[own])
            hit = np.flatnonzero(there)
            yield (own[hit] if self.n > 1 else hit), table.values[at[hit]]
            if self.n > 1 and getattr(part, "_path", None):  # read again from the executor's disk when needed
                part.__dict__.pop("_value", None)

    @property
    def batch_bytes(self) -> int:
        """Bytes of text worth reading between two shards."""
        return SLICE_BYTES if self.n == 1 else SHARDED_BYTES


def added_by_owner(total: np.ndarray, owner: np.ndarray, values: np.ndarray) -> None:
    """Adds each row of values to its owner's total; owners ascend."""
    if len(owner):
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        total[owner[first]] += np.add.reduceat(values, first, axis=0, dtype=np.float64)
