"""Token ids in binary files with constant-time keyed access.

Documents are dealt by ranges of their keys, so that shard after shard, and within a shard, they
ascend. A task writes two files for its shard: the raw payload (little-endian ids in a row) and an
index: a minimal perfect hash (levels of bit maps: a key takes the first level on which it is alone,
and its rank among all set bits is its slot) with, per slot, a stored fingerprint of the key, the key
itself, which is compared where the fingerprint agrees, and the ids' offset. `Shard.get` costs a few
probes however many keys there are.

File names carry a random part and only names in the manifest that Spark has committed are read, so
retried or lost tasks leave nothing that counts. Ids take 2 bytes where the vocabulary allows.

Cases: null and empty texts are documents with the end id alone; repeated keys are told apart by
their ordinal within the shard; a null key sorts first; an empty table gives no shard; other columns
are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, shared_dir, slices, texts
from .tokens import ByteLevel, loaded

#: Bits of a level's map for each key that is left.
SPREAD = 2.0
LEVELS = 48
#: Bytes of text that are encoded at a time, and keys that are read at a time.
ENCODED_BYTES, READ_KEYS = 6 << 20, 1024
MAGIC = b"TLIX1\0\0\0"
NULL_KEY = -(1 << 63)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each key (splitmix finalizer)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_hash(doc_ids: np.ndarray, ordinals: np.ndarray) -> np.ndarray:
    """64 bits from a key and its ordinal among equal keys."""
    return mixed(mixed(doc_ids, 101) ^ mixed(ordinals, 102), 103)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.cumsum([0, *sizes])
        self.ranks = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, maps, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(len(left) * SPREAD))
            at = (mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            maps.append(alone)
            left = left[~alone[at]]
        if len(left):
            raise ValueError("keys repeat")
        return cls(sizes, np.concatenate(maps) if maps else np.zeros(0, bool))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Each key's slot; -1 if it is surely not one of the keys."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = (mixed(keys[left], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def index_bytes(doc_ids: np.ndarray, ordinals: np.ndarray, offsets: np.ndarray, width: int) -> bytes:
    """An index file: header, level sizes, bit map, then by slot the fingerprints, offsets, counts and keys."""
    hashes = key_hash(doc_ids, ordinals)
    found = PerfectHash.build(hashes)
    order = np.argsort(found.slots(hashes))
    prints = (mixed(hashes, 999) >> np.uint64(32)).astype("<u4")
    head = MAGIC + struct.pack("<QQQ", len(hashes), len(found.sizes), width) + np.array(found.sizes, "<u8").tobytes()
    columns = (prints, offsets[:-1].astype("<u8"), np.diff(offsets).astype("<u8"), doc_ids.astype("<i8"), ordinals.astype("<i8"))
    return head + np.packbits(found.bits).tobytes() + b"".join(c[order].tobytes() for c in columns)


class Shard:
    """Keyed access to one shard's files."""

    def __init__(self, index: bytes, payload):
        if index[:8] != MAGIC:
            raise ValueError("not an index file")
        n, levels, width = struct.unpack_from("<QQQ", index, 8)
        at = 32
        sizes = np.frombuffer(index, "<u8", levels, at).astype(np.int64).tolist()
        at += 8 * levels
        bits = sum(sizes)
        self.hash = PerfectHash(sizes, np.unpackbits(np.frombuffer(index, np.uint8, (bits + 7) // 8, at))[:bits].astype(bool))
        at += (bits + 7) // 8
        self.prints = np.frombuffer(index, "<u4", n, at)
        self.begin = np.frombuffer(index, "<u8", n, at + 4 * n)
        self.count = np.frombuffer(index, "<u8", n, at + 12 * n)
        self.doc_ids = np.frombuffer(index, "<i8", n, at + 20 * n)
        self.ordinals = np.frombuffer(index, "<i8", n, at + 28 * n)
        self.dtype, self.payload = np.dtype(f"<u{width}"), payload

    def places(self, doc_ids: np.ndarray, ordinals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(offset, count) of each key in ids; (-1, 0) for a key that is not there."""
        doc_ids, ordinals = np.asarray(doc_ids, np.int64), np.asarray(ordinals, np.int64)
        hashes = key_hash(doc_ids, ordinals)
        slots = self.hash.slots(hashes)
        ok = slots >= 0
        ok[ok] = self.prints[slots[ok]] == (mixed(hashes[ok], 999) >> np.uint64(32)).astype("<u4")
        ok[ok] = (self.doc_ids[slots[ok]] == doc_ids[ok]) & (self.ordinals[slots[ok]] == ordinals[ok])
        begin, count = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        begin[ok], count[ok] = self.begin[slots[ok]], self.count[slots[ok]]
        return begin, count

    def read(self, begin: int, count: int) -> np.ndarray:
        size = self.dtype.itemsize
        self.payload.seek(begin * size)
        return np.frombuffer(self.payload.read(count * size), self.dtype)

    def get(self, doc_id: int, ordinal: int = 0) -> np.ndarray | None:
        """A document's ids."""
        begin, count = self.places(np.array([doc_id]), np.array([ordinal]))
        return None if begin[0] < 0 else self.read(int(begin[0]), int(count[0]))


#: Names that Spark's file systems have besides those that Arrow knows them by.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def store(folder: str):
    """The file system and path of a folder's URI."""
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon:
        return fs.FileSystem.from_uri(f"file://{folder}")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")


def open_shard(folder: str, name: str) -> Shard:
    system, path = store(folder)
    with system.open_input_stream(f"{path}/{name}.idx") as f:
        index = f.read()
    return Shard(index, system.open_input_file(f"{path}/{name}.ids"))


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, added: bool = False) -> DataFrame:
    """Writes the shards; returns the manifest (shard, name, n_docs, n_ids, start), a row for each shard.

    With `added`, strings of added tokens get their ids, as is the library's default; else they are ordinary text.
    """
    spark = docs.sparkSession

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(ByteLevel, tokenizer)
        if end_id >= 1 << 8 * coder.dtype.itemsize:
            raise ValueError("the end id does not fit the ids' width")
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex[:12]}"
        system, path = store(folder)
        keys, sizes, out = [], [], None
        for batch in slices(batches, most=ENCODED_BYTES):
            out = out or system.open_output_stream(f"{path}/{name}.ids")
            ids, ends = coder.encode(texts(batch.column(1)), added)
            keys.append(batch.column(0).fill_null(NULL_KEY).to_numpy(zero_copy_only=False))
            sizes.append(np.diff(ends, prepend=0) + 1)
            out.write(np.insert(ids, ends, end_id).tobytes())
        if out:
            out.close()
            doc_ids = np.concatenate(keys).astype(np.int64)
            place = np.arange(len(doc_ids))
            new = np.concatenate([[True], doc_ids[1:] != doc_ids[:-1]])
            ordinals = place - np.maximum.accumulate(np.where(new, place, 0))
            offsets = np.cumsum(np.concatenate([[0], *sizes])).astype(np.int64)
            with system.open_output_stream(f"{path}/{name}.idx") as f:
                f.write(index_bytes(doc_ids, ordinals, offsets, coder.dtype.itemsize))
            yield pa.RecordBatch.from_pydict({"shard": [shard], "name": [name], "n_docs": [len(doc_ids)], "n_ids": [int(offsets[-1])]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The length makes equal keys fall into several shards without breaking the order of keys.
    rows = rows.repartitionByRange(F.col("doc_id"), F.length("text")).sortWithinPartitions("doc_id", F.length("text"), "text")
    written = materialize(rows.mapInArrow(step, "shard long, name string, n_docs long, n_ids long"), "manifest", folder)
    shards = sorted(written.collect())  # a row for each partition
    starts, manifest = 0, []
    for r in shards:
        manifest.append((r.shard, r.name, r.n_docs, r.n_ids, starts))
        starts += r.n_ids
    return spark.createDataFrame(manifest, "shard long, name string, n_docs long, n_ids long, start long")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document, read back by key: (doc_id, start, n_tokens, ids_crc32)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                shard = open_shard(folder, row["name"])
                order = np.argsort(shard.begin)
                for part in (order[at : at + READ_KEYS] for at in range(0, len(order), READ_KEYS)):
                    doc_ids, ordinals = shard.doc_ids[part], shard.ordinals[part]
                    begin, count = shard.places(doc_ids, ordinals)
                    if (begin < 0).any():
                        raise ValueError("a key is missing from its index")
                    first = int(begin[0])  # keys in the order of their ids lie next to each other
                    raw = memoryview(shard.read(first, int(begin[-1] + count[-1]) - first).astype("<u4").tobytes())
                    crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((begin - first).tolist(), (begin - first + count).tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids, mask=doc_ids == NULL_KEY), pa.array(begin + row["start"]), pa.array(count), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    n = max(1, manifest.count())
    return manifest.repartition(n, "shard").mapInArrow(step, "doc_id long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents, encoded by the library's default, to a new shared folder and returns what is read back."""
    folder = shared_dir(docs.sparkSession)
    return read(write(docs, tokenizer, end_id, folder, added=True), folder)
