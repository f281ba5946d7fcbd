"""Evidence bundles: a Spark data source whose output is complete or absent.

`write_bundle` writes a table as CSV members of one folder. Every task stages its part under a name of its own attempt, reads
it back, compares it with what it wrote, and reports rows, bytes and SHA-256. When all tasks have succeeded the driver checks
that the staged files are there in their sizes, moves them to their members' names, writes manifest.json with each file's hash
and size, and last the marker, which holds the manifest's own hash. If a task fails the staged parts are removed and there is
no bundle. A folder that holds a bundle is never written again.

`read_bundle` reads one that has its marker; each file's hash is compared as it is read, by its own task. `manifest` lists the
files. Values are written so that they come back: doubles in their shortest form, nulls as nothing, text quoted; so an empty
text and a null differ. Dates, binaries and nested values are refused.

The folder must be one that the driver and all executors share, by a path or a URI that pyarrow knows.
"""

from __future__ import annotations

import csv
import hashlib
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

FORMAT = "lacuna_bundle"
MANIFEST, MARKER, STAGED = "manifest.json", "_COMPLETE", "_staged"
VERSION = 1
#: Rows of a member; a task with more writes several.
MEMBER_ROWS = 200_000
_KINDS = (T.StringType, T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")


def _read(path: str) -> bytes:
    store, name = _store(path)
    with store.open_input_stream(name, compression=None) as f:
        return f.read()


def _exists(path: str) -> bool:
    from pyarrow import fs

    store, name = _store(path)
    return store.get_file_info(name).type != fs.FileType.NotFound


def _sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _cell(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return '"' + value.replace('"', '""') + '"'
    return str(value).lower() if isinstance(value, bool) else repr(value)


def encode(rows: list[tuple], names: list[str]) -> bytes:
    """A member: a header and a line for each row, in their order."""
    return "\n".join([",".join(map(_cell, names)), *(",".join(map(_cell, row)) for row in rows), ""]).encode("utf-8", "surrogatepass")


def decode(data: bytes, schema: T.StructType) -> Iterator[tuple]:
    """The rows of a member."""
    convert = [{T.StringType: str, T.BooleanType: lambda v: v == "true", T.FloatType: float, T.DoubleType: float}.get(type(f.dataType), int) for f in schema.fields]
    lines = csv.reader(io.StringIO(data.decode("utf-8", "surrogatepass"), newline=""), quoting=csv.QUOTE_NOTNULL)
    if next(lines) != schema.names:
        raise ValueError("a bundle's member has other columns than its manifest")
    for line in lines:
        yield tuple(None if v is None or v == "" and kind is not str else kind(v) for v, kind in zip(line, convert, strict=True))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged."""

    part: int
    files: list[dict]


class BundleWriter(DataSourceWriter):
    def __init__(self, path: str, schema: T.StructType) -> None:
        for f in schema.fields:
            if not isinstance(f.dataType, _KINDS):
                raise TypeError(f"a bundle can't hold {f.name} {f.dataType.simpleString()}")
        self.path, self.schema = path, schema

    def write(self, iterator: Iterator[Row]) -> Staged:
        from pyspark import TaskContext

        part, files, rows = TaskContext.get().partitionId(), [], []
        for row in iterator:
            rows.append(tuple(row))
            if len(rows) == MEMBER_ROWS:
                files.append(self._stage(part, rows))
                rows = []
        return Staged(part, files + [self._stage(part, rows)] * bool(rows))

    def _stage(self, part: int, rows: list[tuple]) -> dict:
        """Write a member under a name of its own and read it back."""
        data, name = encode(rows, self.schema.names), f"part-{part:06d}-{uuid.uuid4().hex}.csv"
        store, root = _store(f"{self.path}/{STAGED}")
        store.create_dir(root, recursive=True)
        with store.open_output_stream(f"{root}/{name}", compression=None) as f:
            f.write(data)
        again = _read(f"{self.path}/{STAGED}/{name}")
        same = lambda a, b: a == b or (a != a and b != b)
        if again != data or any(not same(x, y) for a, b in zip(decode(again, self.schema), rows, strict=True) for x, y in zip(a, b, strict=True)):
            raise ValueError(f"a staged member of a bundle isn't what was written: {name}")
        return {"name": name, "rows": len(rows), "bytes": len(data), "sha256": _sha(data)}

    def commit(self, messages: list[Staged | None]) -> None:
        if _exists(f"{self.path}/{MARKER}"):
            self.abort(messages)
            raise FileExistsError(f"a bundle is never written again: {self.path}")
        store, root = _store(self.path)
        store.create_dir(root, recursive=True)
        files = []
        staged = [f for m in sorted((m for m in messages if m), key=lambda m: m.part) for f in m.files]
        for f in staged:
            if store.get_file_info(f"{root}/{STAGED}/{f['name']}").size != f["bytes"]:
                self.abort(messages)
                raise ValueError(f"a staged member of a bundle has changed: {f['name']}")
        for k, f in enumerate(staged):
            store.move(f"{root}/{STAGED}/{f['name']}", f"{root}/part-{k:06d}.csv")
            files.append(f | {"name": f"part-{k:06d}.csv"})
        if _exists(f"{self.path}/{STAGED}"):
            store.delete_dir(f"{root}/{STAGED}")
        manifest = json.dumps({"version": VERSION, "schema": json.loads(self.schema.json()), "files": files}, sort_keys=True, separators=(",", ":")).encode()
        for name, data in ((MANIFEST, manifest), (MARKER, _sha(manifest).encode())):  # the marker is last
            with store.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(data)

    def abort(self, messages: list[Staged | None]) -> None:
        """Remove what was staged; parts of tasks that never reported lie in the same folder."""
        if _exists(f"{self.path}/{STAGED}"):
            store, root = _store(self.path)
            store.delete_dir(f"{root}/{STAGED}")


class Member(InputPartition):
    def __init__(self, name: str, sha256: str) -> None:
        super().__init__(name)
        self.name, self.sha256 = name, sha256


class BundleReader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def partitions(self) -> list[Member]:
        return [Member(f["name"], f["sha256"]) for f in _manifest(self.path)["files"]]

    def read(self, partition: Member) -> Iterator[tuple]:
        if not isinstance(partition, Member):  # a bundle without a file
            return
        data = _read(f"{self.path}/{partition.name}")
        if _sha(data) != partition.sha256:
            raise ValueError(f"a member of a bundle isn't what its manifest says: {partition.name}")
        yield from decode(data, self.schema)


class BundleSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(_manifest(self.options["path"])["schema"])

    def reader(self, schema: T.StructType) -> BundleReader:
        return BundleReader(self.options["path"], schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> BundleWriter:
        return BundleWriter(self.options["path"], schema)


def _manifest(path: str) -> dict:
    """The manifest of a complete bundle."""
    if not _exists(f"{path}/{MARKER}"):
        raise FileNotFoundError(f"no complete bundle: {path}")
    data = _read(f"{path}/{MANIFEST}")
    if _sha(data) != _read(f"{path}/{MARKER}").decode():
        raise ValueError(f"the manifest of a bundle has changed: {path}")
    return json.loads(data)


def write_bundle(rows: DataFrame, path: str) -> None:
    """Write a table as a bundle: files of bounded size in the order of the partitions and their rows."""
    if _exists(f"{path}/{MARKER}"):
        raise FileExistsError(f"a bundle is never written again: {path}")
    rows.sparkSession.dataSource.register(BundleSource)
    rows.write.format(FORMAT).mode("append").save(path)


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(BundleSource)
    return spark.read.format(FORMAT).load(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, bytes, sha256 of a bundle's files."""
    files = _manifest(path)["files"]
    return spark.createDataFrame([(f["name"], f["rows"], f["bytes"], f["sha256"]) for f in files], "name string, rows long, bytes long, sha256 string")
