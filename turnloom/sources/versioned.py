"""Tables in a folder with versions, as a Spark data source.

Each version is a manifest that lists the files of each table; a write stages its files, then creates the manifest after the one
that it started from. A manifest is created only if there is none of its number, so of two writes from one version the second is
refused, and its files go; a write that fails leaves nothing that readers see (`vacuum` deletes what killed tasks leave). Several tables are staged under one
transaction and appear at once.

    spark.dataSource.register(versioned.Source)
    df.write.format("versioned").mode("append").option("table", "records").save(path)
    spark.read.format("versioned").option("table", "records").load(path)

Options: `table` (records), `version` (to read an older one), `expected` (the version to write after; the newest by default) and
`transaction` (a name: stage only, for `publish`). Cases: a folder without a manifest is version 0, without tables; reading a
table that a version lacks is an error, as is appending rows of another schema; mode overwrite replaces the table.
"""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

MANIFESTS, STAGED = "_versions", "_staged"


class Conflict(ValueError):
    """Another write has taken the version."""


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def create(fs: pafs.FileSystem, path: str, data: bytes) -> None:
    """Creates a file that must not exist. One step where the file system can (mounted ones); elsewhere a look, then a move."""
    if isinstance(fs, pafs.LocalFileSystem):
        temp = f"{path}.{uuid.uuid4().hex}"
        with open(temp, "xb") as f:
            f.write(data)
        try:
            os.link(temp, path)  # fails if there is one, and shows whole files only
        except FileExistsError as e:
            raise Conflict(f"{path} exists") from e
        finally:
            os.unlink(temp)
        return
    if fs.get_file_info(path).type != pafs.FileType.NotFound:
        raise Conflict(f"{path} exists")
    temp = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, path)


def newest(path: str) -> int:
    """The newest version; 0 if there is none."""
    fs, root = located(path)
    found = fs.get_file_info(pafs.FileSelector(f"{root}/{MANIFESTS}", allow_not_found=True))
    names = (os.path.splitext(x.base_name) for x in found)
    return max((int(n) for n, kind in names if kind == ".json" and n.isdigit()), default=0)


def manifest(path: str, version: int | None = None) -> dict:
    """{"version", "tables": {name: {"schema", "files"}}} of a version, the newest by default."""
    version = newest(path) if version is None else version
    if not version:
        return {"version": 0, "tables": {}}
    fs, root = located(path)
    with fs.open_input_stream(f"{root}/{MANIFESTS}/{version:012d}.json") as f:
        return json.loads(f.read())


def published(path: str, staged: dict[str, dict], expected: int) -> int:
    """Makes the version after the expected one, with the staged files of tables; returns its number."""
    tables = manifest(path, expected)["tables"]
    for name, new in staged.items():
        old = tables.get(name)
        if old and not new["replace"]:
            if old["schema"] != new["schema"]:
                raise ValueError(f"table {name} has another schema")
            new = {**new, "files": [*old["files"], *new["files"]]}
        tables[name] = {"schema": new["schema"], "files": new["files"]}
    fs, root = located(path)
    fs.create_dir(f"{root}/{MANIFESTS}")
    if newest(path) != expected:
        raise Conflict(f"version {expected} is not the newest of {path}")
    create(fs, f"{root}/{MANIFESTS}/{expected + 1:012d}.json", json.dumps({"version": expected + 1, "tables": tables}).encode())
    return expected + 1


def dropped(path: str, files: list[str]) -> None:
    fs, root = located(path)
    for name in files:
        with contextlib.suppress(FileNotFoundError):
            fs.delete_file(f"{root}/{name}")


def publish(path: str, transaction: str, expected: int | None = None) -> int:
    """Makes all tables that a transaction has staged visible at once; if it is refused, they go."""
    fs, root = located(path)
    folder = f"{root}/{STAGED}/{transaction}"
    staged = {}
    for x in fs.get_file_info(pafs.FileSelector(folder)):
        with fs.open_input_stream(x.path) as f:
            staged[os.path.splitext(x.base_name)[0]] = json.loads(f.read())
    try:
        return published(path, staged, newest(path) if expected is None else expected)
    except ValueError:
        dropped(path, [f for t in staged.values() for f in t["files"]])
        raise
    finally:
        fs.delete_dir(folder)


def vacuum(path: str) -> int:
    """Deletes data files that no version and no transaction lists; returns how many. Not while a write is under way."""
    fs, root = located(path)
    known = {f for v in range(1, newest(path) + 1) for t in manifest(path, v)["tables"].values() for f in t["files"]}
    for x in fs.get_file_info(pafs.FileSelector(f"{root}/{STAGED}", recursive=True, allow_not_found=True)):
        if x.is_file:
            with fs.open_input_stream(x.path) as f:
                known.update(json.loads(f.read())["files"])
    gone = [x.base_name for x in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if x.extension == "parquet" and x.base_name not in known]
    dropped(path, gone)
    return len(gone)


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


@dataclass
class Piece(InputPartition):
    file: str


class Reader(DataSourceReader):
    def __init__(self, path: str, files: list[str], schema: StructType):
        self.path, self.files, self.names = path, files, schema.names

    def partitions(self) -> list[Piece]:
        return [Piece(f) for f in self.files]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        if partition is None or getattr(partition, "file", None) is None:  # a table without files
            return
        fs, root = located(self.path)
        with fs.open_input_file(f"{root}/{partition.file}") as f:
            yield from (b.select(self.names) for b in pq.ParquetFile(f).iter_batches())


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, table: str, schema: StructType, replace: bool, expected: int, transaction: str | None):
        self.path, self.table, self.schema, self.replace, self.expected, self.transaction = path, table, schema.json(), replace, expected, transaction
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = located(self.path)
        name = f"{self.table}-{self.job}-{uuid.uuid4().hex}.parquet"
        fs.create_dir(root)
        out = None
        try:
            for batch in iterator:
                if out is None and batch.num_rows:
                    out = pq.ParquetWriter(f"{root}/{name}", batch.schema, filesystem=fs)
                if batch.num_rows:
                    out.write_batch(batch)
            if out is not None:
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                dropped(self.path, [name])
            raise
        return Written([name] if out is not None else [])

    def commit(self, messages: list[Written | None]) -> None:
        staged = {"schema": self.schema, "files": [f for m in messages if m for f in m.files], "replace": self.replace}
        if self.transaction is None:
            published(self.path, {self.table: staged}, self.expected)
            return
        fs, root = located(self.path)
        folder = f"{root}/{STAGED}/{self.transaction}"
        fs.create_dir(folder)
        create(fs, f"{folder}/{self.table}.json", json.dumps(staged).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = located(self.path)
        found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        dropped(self.path, [x.base_name for x in found if x.base_name.startswith(f"{self.table}-{self.job}-")])


class Source(DataSource):
    @classmethod
    def name(cls) -> str:
        return "versioned"

    def table(self) -> str:
        return self.options.get("table", "records")

    def held(self) -> dict:
        version = self.options.get("version")
        tables = manifest(self.options["path"], None if version is None else int(version))["tables"]
        if self.table() not in tables:
            raise ValueError(f"no table {self.table()} in {self.options['path']}")
        return tables[self.table()]

    def schema(self) -> StructType:
        return StructType.fromJson(json.loads(self.held()["schema"]))

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.held()["files"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        path, expected = self.options["path"], self.options.get("expected")
        return Writer(path, self.table(), schema, overwrite, newest(path) if expected is None else int(expected), self.options.get("transaction"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Source)
