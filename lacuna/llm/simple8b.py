"""Token-ID output in Simple-8b words, and its reader.

Format of a shard (little-endian): magic `LSIMPLE8`, then as unsigned 64-bit integers block size, ids, blocks, words,
escapes, documents; then the arrays block_offset (blocks + 1, in words), escapes, doc_id (signed), doc_null (0 or 1),
doc_start (documents + 1, in ids of the shard) and the words. A word's low 4 bits are a selector, the other 60 hold so
many ids of so many bits; selector 0 is an escape whose payload is an index into the array of escapes, so every word of a
block can be decoded by itself, all words at once. A block has `block` ids (the last one may have fewer).

Shards hold the documents in ascending order of doc_id. Rows: repeated rows are documents of their own (ties by text); a
null doc_id sorts first; a null or empty text has the end id alone; an empty table gives no shard and no row; columns
besides doc_id and text are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_limits, materialize, shared_dir
from .tokens import encoder

MAGIC = b"LSIMPLE8"
#: Selector: ids in a word, bits of each. Selector 0 is the escape.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([60, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
BLOCK = 1024
SHARD_IDS = 8_000_000
#: Tasks that read shards; beyond so many files a task reads several.
MAX_READERS = 20_000
_PAD = 64
_STEP = 1 << 21


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, block offsets in words, escapes) of unsigned ids."""
    words, sizes, escapes, known = [], [], [], 0
    step = max(1, _STEP // block) * block
    for lo in range(0, len(ids), step):
        w, n, e = _encode_blocks(ids[lo : lo + step].astype(np.uint64), block, known)
        words.append(w)
        sizes.append(n)
        escapes.append(e)
        known += len(e)
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(words, np.uint64), np.concatenate([[0], np.cumsum(join(sizes, np.int64))]).astype(np.uint64), join(escapes, np.uint64)


#: Distinct widths in order; the place of a selector's width among them.
_WIDTHS = np.unique(BITS[1:15])
_LANE = np.searchsorted(_WIDTHS, BITS)
_SMALL = np.searchsorted(np.uint64(1) << _WIDTHS.astype(np.uint64), np.arange(1 << 16, dtype=np.uint64), side="right").astype(np.uint8)


def _lanes(ids: np.ndarray) -> np.ndarray:
    """For each id the place of the least width that holds it; one past the last if none does."""
    out = _SMALL[np.minimum(ids, np.uint64(0xFFFF)).astype(np.int64)]
    large = ids > 0xFFFF
    if large.any():
        out[large] = np.searchsorted(np.uint64(1) << _WIDTHS.astype(np.uint64), ids[large], side="right")
    return out


def _encode_blocks(ids: np.ndarray, block: int, known: int):
    rows = -(-len(ids) // block)
    grid = np.zeros((rows, block + _PAD), np.uint64)
    grid[:, :block] = np.concatenate([ids, np.zeros(rows * block - len(ids), np.uint64)]).reshape(rows, block)
    counts = np.full(rows, block)
    counts[-1] = len(ids) - (rows - 1) * block
    need = _lanes(grid)
    selector, widest = np.zeros((rows, block), np.int8), {1: need}
    for s in range(14, 0, -1):  # what packs more ids overwrites what packs fewer
        n = int(COUNT[s])
        if n not in widest:  # the widest of n ids from two overlapping stretches of fewer
            half = next(k for k in sorted(widest, reverse=True) if k < n)
            while 2 * half < n:
                widest[2 * half] = np.maximum(widest[half][:, :-half], widest[half][:, half:])
                half *= 2
            widest[n] = np.maximum(widest[half][:, : grid.shape[1] - n + 1], widest[half][:, n - half : grid.shape[1] - half + 1])
        selector[widest[n][:, :block] <= _LANE[s]] = s
    at, chain, row = np.zeros(rows, np.int64), [], np.arange(rows)
    while True:
        live = at < counts
        if not live.any():
            break
        chain.append(np.where(live, at, -1))
        at = at + COUNT[selector[row, np.minimum(at, block - 1)]]
    where = np.stack(chain, axis=1)
    r, c = np.nonzero(where >= 0)
    start = where[r, c]
    chosen = selector[r, start]
    words = np.zeros(len(r), np.uint64)
    for s in np.unique(chosen):
        mine = np.flatnonzero(chosen == s)
        if s == 0:
            payload = np.arange(known, known + len(mine)).astype(np.uint64)
        else:
            lane = np.arange(COUNT[s])
            payload = np.bitwise_or.reduce(grid[r[mine][:, None], start[mine][:, None] + lane] << (lane * BITS[s]).astype(np.uint64), axis=1)
        words[mine] = (payload << np.uint64(4)) | np.uint64(s)
    lost = chosen == 0
    return words, np.bincount(r, minlength=rows), grid[r[lost], start[lost]]


def decode(words: np.ndarray, offsets: np.ndarray, escapes: np.ndarray, n_ids: int, block: int = BLOCK) -> np.ndarray:
    """The ids; any run of whole blocks can be given, with its own offsets and number of ids."""
    out = []
    step = max(1, _STEP // block)
    offsets = offsets.astype(np.int64)
    for lo in range(0, len(offsets) - 1, step):
        edge = offsets[lo : lo + step + 1]
        w = words[edge[0] : edge[-1]]
        sel, payload = (w & np.uint64(15)).astype(np.int64), w >> np.uint64(4)
        row = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
        total = np.cumsum(COUNT[sel]) - COUNT[sel]
        at = total - total[np.minimum(edge[:-1] - edge[0], max(len(w) - 1, 0))][row]
        grid = np.zeros((len(edge) - 1, block + _PAD), np.uint64)
        for s in np.unique(sel):
            mine = np.flatnonzero(sel == s)
            if s == 0:
                grid[row[mine], at[mine]] = escapes[payload[mine].astype(np.int64)]
            else:
                lane = np.arange(COUNT[s])
                mask = np.uint64((1 << int(BITS[s])) - 1)
                grid[row[mine][:, None], at[mine][:, None] + lane] = (payload[mine][:, None] >> (lane * BITS[s]).astype(np.uint64)) & mask
        out.append(grid[:, :block].ravel())
    return np.concatenate(out)[:n_ids] if out else np.zeros(0, np.uint64)


def to_bytes(ids: np.ndarray, doc_id: np.ndarray, doc_null: np.ndarray, doc_start: np.ndarray, block: int = BLOCK) -> bytes:
    words, offsets, escapes = encode(ids, block)
    head = np.array([block, len(ids), len(offsets) - 1, len(words), len(escapes), len(doc_id)], "<u8")
    return b"".join([MAGIC, head.tobytes(), offsets.astype("<u8").tobytes(), escapes.astype("<u8").tobytes(), doc_id.astype("<i8").tobytes(), doc_null.astype("u1").tobytes(), doc_start.astype("<u8").tobytes(), words.astype("<u8").tobytes()])


def from_bytes(data: bytes):
    """(ids, doc_id, doc_null, doc_start) of a shard."""
    if data[:8] != MAGIC:
        raise ValueError("not a Simple-8b shard")
    block, n_ids, n_blocks, n_words, n_escapes, n_docs = (int(x) for x in np.frombuffer(data, "<u8", 6, 8))
    at, parts = 56, []
    for kind, n in (("<u8", n_blocks + 1), ("<u8", n_escapes), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs + 1), ("<u8", n_words)):
        parts.append(np.frombuffer(data, kind, n, at))
        at += parts[-1].nbytes
    offsets, escapes, doc_id, doc_null, doc_start, words = parts
    return decode(words, offsets, escapes, n_ids, block), doc_id, doc_null, doc_start


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int = 1, out: str | None = None, block: int = BLOCK) -> DataFrame:
    """Write documents as shards below `out` (a folder that all executors reach) and return the manifest.

    Manifest: shard long, part int, path string, n_ids long, n_docs long; (shard, part) is ascending in doc_id. A file's
    name is new for each task attempt and only the attempts that Spark commits are in the manifest.
    """
    out = out or f"{shared_dir(docs.sparkSession)}/token-shards-{uuid.uuid4().hex}"
    arrow_limits(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        store, root = _store(out)
        store.create_dir(root, recursive=True)
        made, ids, ns, keys = [], [], [], []

        def flush() -> None:
            flat, null = np.frombuffer(b"".join(ids), "<u4"), np.array([k is None for k in keys], "u1")
            starts = np.concatenate([[0], np.cumsum(ns)])
            path = f"{root}/shard-{shard:06d}-{len(made):04d}-{uuid.uuid4().hex}.s8b"
            with store.open_output_stream(path) as f:
                f.write(to_bytes(flat, np.array([k or 0 for k in keys], np.int64), null, starts, block))
            made.append((shard, len(made), f"{out}/{path.rpartition('/')[2]}", len(flat), len(keys)))
            ids.clear()
            ns.clear()
            keys.clear()

        held = 0
        for batch in batches:
            for key, one in zip(batch.column(0).to_pylist(), enc.ids_of(batch.column(1).to_pylist()), strict=True):
                one += end
                ids.append(one)
                ns.append(len(one) // 4)
                keys.append(key)
                held += ns[-1]
                if held >= SHARD_IDS:
                    flush()
                    held = 0
        if keys:
            flush()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("shard", "part", "path", "n_ids", "n_docs"), map(list, zip(*made, strict=True)), strict=True)), pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("path", pa.string()), ("n_ids", pa.int64()), ("n_docs", pa.int64())]))

    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(write, "shard long, part int, path string, n_ids long, n_docs long"), "token-manifest")


def read_token_shards(manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids as little-endian uint32 bytes.

    The running total is over the manifest, which has a row for each file and not for each document.
    """
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _store(row["path"])
                with store.open_input_stream(path) as f:
                    ids, doc_id, null, starts = from_bytes(f.read())
                flat, edge = ids.astype("<u4"), starts.astype(np.int64)
                texts = [flat[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                columns = [pa.array(doc_id, mask=null.astype(bool)), pa.array(edge[:-1] + row["before"]), pa.array(np.diff(edge)), pa.array([zlib.crc32(t) for t in texts], pa.int64())] + [pa.array(texts, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds))

    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.select("shard", "part", "path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    spread = listed.repartition(min(max(1, manifest.count()), MAX_READERS)).select("path", "before")  # a task for each file
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
