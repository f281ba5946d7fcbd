"""WARC archives: a writer, a reader and the resolution of revisits.

`write_archives` writes a response record for each page, a gzip member each, in files of bounded size below a shared folder.
`read_headers` and `read_records` read archives back, gzipped or not, of any writer.
`deduplicate` shuffles the headers of all records by payload digest, never the payloads: of the records with equal payloads of
at least `least` bytes that with the smallest page_id is the original, and the others are joined to it. Each archive is then
rewritten by a task that reads it once in its own order: originals keep their payload under fresh headers, the others become
revisit records (profile identical-payload-digest) that name the original's record, address, date and page. A digest that
more than a thousandth of all records share, of which there can't be more than a thousand, is joined by broadcast, so a
payload that a third of all pages have fills no task. Revisit records of the input are joined to the response that has their
digest and stay revisits.

Files: the name is new for each task attempt, and only the attempts that Spark commits are in the manifest, a written table.
Payloads are equal if SHA-256 and length are. Fields of our own are X-Page-Id, X-Payload-Length and X-Refers-To-Page-Id.

Rows: a null html is an empty payload; a null url is left out; a null page_id comes after all others as an original; of
repeated rows the one first written is the original; an empty table gives no file and no row; other columns are ignored. A
payload has to fit into a task's memory.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from itertools import count
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, materialize, shared_dir

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST = 100
#: Bytes of records, before compression, from which on a task starts a new file.
FILE_BYTES = 256 << 20
#: A payload that more than one in so many records has is joined by broadcast.
HOT_SHARE = 1000
_EPOCH = "1970-01-01T00:00:00Z"
_FILES = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
_FILES_SQL = "path string, records long, bytes long"
#: Columns of a header: where the record is and what it says.
_HEADERS = [("path", pa.string()), ("number", pa.int64()), ("record_id", pa.string()), ("type", pa.string()), ("uri", pa.string()), ("date", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to_id", pa.string()), ("refers_to", pa.int64())]
_HEADERS_SQL = "path string, number long, record_id string, type string, uri string, date string, page_id long, payload_digest string, payload_bytes long, refers_to_id string, refers_to long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def record(fields: list[tuple[str, object]], block: bytes, level: int = 6) -> bytes:
    """A record as a gzip member; fields without a value are left out, and line ends in values become blanks."""
    lines = [VERSION, *(f"{k}: {' '.join(str(v).splitlines())}".encode("utf-8", "surrogatepass") for k, v in fields if v is not None), f"Content-Length: {len(block)}".encode(), b"", b""]
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([packer.compress(b"\r\n".join(lines)), packer.compress(block), packer.compress(b"\r\n\r\n"), packer.flush()])


def http_response(payload: bytes | None, length: int) -> bytes:
    """The block of a response, or of a revisit if there is no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    return head + (payload or b"")


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a block; the whole block if there is no such header."""
    if not block.startswith(b"HTTP/"):
        return block
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found else b""


def records(raw: BinaryIO) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number in the file, fields by lower-case name, block) of each record of an archive, whether gzipped or not."""
    stream = io.BufferedReader(raw, 1 << 20)
    if stream.peek(2)[:2] == b"\x1f\x8b":
        stream = io.BufferedReader(gzip.GzipFile(fileobj=stream), 1 << 16)
    for number in count():
        while (line := stream.readline()) in (b"\r\n", b"\n"):
            pass
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields: dict[str, str] = {}
        last = ""
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            text = line.decode("utf-8", "surrogatepass").rstrip("\r\n")
            if text[:1] in (" ", "\t") and last:  # a folded line
                fields[last] += f" {text.strip()}"
                continue
            name, _, value = text.partition(":")
            last = name.strip().lower()
            fields.setdefault(last, value.strip())
        size = int(fields["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record ends early")
        yield number, fields, block


class _Writer:
    """Records of a task into files of bounded size."""

    def __init__(self, out: str) -> None:
        self.out, self.done, self.file = out, [], None
        self.store, self.root = _store(out)
        self.store.create_dir(self.root, recursive=True)

    def add(self, fields: list[tuple[str, object]], block: bytes) -> None:
        if self.file is None:
            self.name = f"{uuid.uuid4().hex}.warc.gz"
            self.file, self.count, self.size = self.store.open_output_stream(f"{self.root}/{self.name}", compression=None), 0, 0
            self.file.write(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", _EPOCH), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.file.write(record(fields, block))
        self.count, self.size = self.count + 1, self.size + len(block)
        if self.size >= FILE_BYTES:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((f"{self.out}/{self.name}", self.count, self.size))
            self.file = None

    def manifest(self) -> Iterator[pa.RecordBatch]:
        self.close()
        if self.done:
            yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*self.done, strict=True)], schema=_FILES)


def _fields(kind: str, record_id: str, digest: str, length: int, page_id: int | None, uri: str | None, date: str | None, *more: tuple[str, object]) -> list[tuple[str, object]]:
    return [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date or _EPOCH), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("X-Page-Id", page_id), ("X-Payload-Length", length), *more]


def write_archives(pages: DataFrame, out: str | None = None) -> DataFrame:
    """Write a response record for each page below `out` and return the manifest: path, records, bytes of blocks."""
    spark = pages.sparkSession
    out = out or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    arrow_limits(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(out)
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                writer.add(_fields("response", f"<urn:uuid:{uuid.uuid4()}>", hashlib.sha256(payload).hexdigest(), len(payload), page_id, url, None), http_response(payload, len(payload)))
        yield from writer.manifest()

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(write, _FILES_SQL)
    return materialize(rows, "warc-manifest")


def _spread(manifest: DataFrame) -> DataFrame:
    """Paths, about one to a task."""
    return manifest.select("path").repartition(min(max(1, manifest.count()), 20_000))


def _header(path: str, number: int, fields: dict[str, str], block: bytes) -> tuple:
    kind = fields.get("warc-type", "")
    value = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
    if kind == "revisit":
        digest, size = fields.get("warc-payload-digest", "").removeprefix("sha256:") or None, value("x-payload-length")
    else:  # what is there counts, not what the header says
        payload = payload_of(block)
        digest, size = hashlib.sha256(payload).hexdigest(), len(payload)
    return (path, number, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-date"), value("x-page-id"), digest, size, fields.get("warc-refers-to"), value("x-refers-to-page-id"))


def _read(manifest: DataFrame, with_payload: bool) -> DataFrame:
    kinds = _HEADERS + [("payload", pa.binary())] * with_payload
    schema = pa.schema(kinds)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = _store(path)
                rows: list[tuple] = []
                held = 0
                with store.open_input_stream(name, compression=None) as f:
                    for number, fields, block in records(f):
                        if fields.get("warc-type") in ("response", "resource", "revisit"):
                            payload = payload_of(block) if fields["warc-type"] != "revisit" else None
                            rows.append(_header(path, number, fields, block) + (payload,) * with_payload)
                            held += len(block) * with_payload + 300
                        if held > 16 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows, strict=True), kinds, strict=True)], schema=schema)

    return _spread(manifest).mapInArrow(read, _HEADERS_SQL + ", payload binary" * with_payload)


def read_headers(manifest: DataFrame) -> DataFrame:
    """Headers of all response, resource and revisit records of the archives; digest and length are of the payload that was read."""
    return _read(manifest, False)


def read_records(manifest: DataFrame) -> DataFrame:
    """Headers and payload (null for a revisit) of all such records."""
    return _read(manifest, True)


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """The headers with record_type, fresh_id, and original (record's fresh_id, uri, date, page_id; null for a response).

    `headers` should be a written table: it is read several times.
    """
    fresh = F.concat(F.lit("<urn:uuid:"), F.regexp_replace(F.substring(F.sha2(F.concat_ws("|", "path", F.col("number").cast("string")), 256), 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))
    held = headers.withColumn("fresh_id", fresh)
    can_be = (F.col("type") != "revisit") & (F.col("payload_bytes") >= least)
    first = F.min(F.when(can_be, F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "path", "number", "fresh_id", "uri", "date")))
    groups = held.groupBy("payload_digest").agg(first.alias("first"), F.max("payload_bytes").alias("size"), F.count(F.lit(1)).alias("copies")).where("first is not null and copies > 1")
    groups = materialize(groups.select("payload_digest", "copies", F.struct("first.fresh_id", "first.uri", "first.date", "first.page_id", "size").alias("original")), "warc-originals")
    most = max(1, headers.count() // HOT_SHARE)
    hot = F.broadcast(groups.where(F.col("copies") > most).drop("copies"))  # at most HOT_SHARE of them
    cold = groups.where(F.col("copies") <= most).drop("copies")
    joined = held.join(hot, "payload_digest").unionByName(held.join(hot, "payload_digest", "left_anti").join(cold, "payload_digest", "left"))
    again = F.col("original").isNotNull() & (F.col("original.fresh_id") != F.col("fresh_id")) & ((F.col("type") == "revisit") | (F.col("payload_bytes") >= least))
    return joined.withColumn("original", F.when(again, F.col("original"))).withColumn("record_type", F.when(again | (F.col("type") == "revisit"), "revisit").otherwise("response"))


def deduplicate(manifest: DataFrame, out: str | None = None, least: int = LEAST) -> DataFrame:
    """Rewrite archives so that each payload is held once; returns the manifest of the new ones."""
    spark = manifest.sparkSession
    out = out or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    headers = materialize(read_headers(manifest), "warc-headers")
    wanted = resolve(headers, least).select("path", "number", "record_type", "fresh_id", "payload_digest", "payload_bytes", "page_id", "uri", "date", "refers_to_id", F.col("original.fresh_id").alias("to_id"), F.col("original.uri").alias("to_uri"), F.col("original.date").alias("to_date"), F.col("original.page_id").alias("to_page"), F.col("original.size").alias("size"))
    names = wanted.columns

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, path, source, stream = _Writer(out), None, None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(names, row, strict=True))
                if r["path"] != path:
                    if source is not None:
                        source.close()
                    path = r["path"]
                    store, name = _store(path)
                    source = store.open_input_stream(name, compression=None)
                    stream = records(source)
                block = next(b for number, _, b in stream if number == r["number"])
                size = r["payload_bytes"] if r["payload_bytes"] is not None else r["size"]
                again = r["record_type"] == "revisit"
                more = []
                if again:
                    more = [("WARC-Profile", PROFILE), ("WARC-Refers-To", r["to_id"] or r["refers_to_id"]), ("WARC-Refers-To-Target-URI", r["to_uri"]), ("WARC-Refers-To-Date", r["to_date"]), ("X-Refers-To-Page-Id", r["to_page"])]
                body = http_response(None if again else payload_of(block), size or 0)
                writer.add(_fields(r["record_type"], r["fresh_id"], r["payload_digest"] or "", size or 0, r["page_id"], r["uri"], r["date"], *more), body)
        if source is not None:
            source.close()
        yield from writer.manifest()

    tasks = min(max(1, manifest.count()), 20_000)
    rows = wanted.repartition(tasks, "path").sortWithinPartitions("path", "number").mapInArrow(rewrite, _FILES_SQL)
    return materialize(rows, "warc-manifest")


def read_pages(manifest: DataFrame) -> DataFrame:
    """page_id, url, payload of every record, that of a revisit from the record it refers to."""
    held = materialize(read_records(manifest), "warc-records")
    whole = held.where("type <> 'revisit'")
    again = held.where("type = 'revisit'").select("page_id", "uri", "refers_to_id").join(whole.select(F.col("record_id").alias("refers_to_id"), "payload"), "refers_to_id", "left")
    return whole.select("page_id", F.col("uri").alias("url"), "payload").unionByName(again.select("page_id", F.col("uri").alias("url"), "payload"))
