"""Benchmark decontamination: a broadcast set of n-gram hashes of the test items, scanned over every text, hits verified.

A window is `n` consecutive words of an item; an item of fewer words, but not none, is one window. Words are
`[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z has been lower-cased. A hash hit counts only if the words themselves are
equal. The set is broadcast in blocks of at most `block_windows` windows, so what an executor holds is bounded however
large the benchmark is: with one block (any usual benchmark) the scan is one pass without a shuffle; with more, each block
scans the corpus and the hits of a document are merged by (doc_id, hash of the text).

Rows: a null text has no words; a null item text has no window; windows of an item without an id are hit, but it is not
among the items; repeated documents get the same result; repeated item ids count once; an empty benchmark hits nothing; other columns of the documents are carried along by `decontaminate`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, Words, arrow_limits, batches, utf8

WINDOW = 10
BLOCK_WINDOWS = 1_000_000


class WindowSet:
    """Windows by number of words: sorted hashes for the scan, words and items for the check."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = WINDOW) -> None:
        self.exact: dict[int, dict[bytes, list[int]]] = {}
        self.items = [key for key, _ in items]
        words = Words(utf8([text for _, text in items]), ALNUM)
        for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
            size = min(n, b - a)
            for k in range(a, b - size + 1) if size else ():
                held = self.exact.setdefault(size, {}).setdefault(words_at(words, k, size), [])
                if i not in held:
                    held.append(i)
        self.hashes = {}
        for size, found in self.exact.items():
            own = Words(list(found), ALNUM)
            self.hashes[size] = np.unique(own.grams(size)[own.first])


def words_at(words: Words, k: int, n: int) -> bytes:
    """The n words from word k on, lower-cased and joined by a blank."""
    return b" ".join(words.data[a:b].lower() for a, b in zip(words.start[k : k + n].tolist(), words.end[k : k + n].tolist(), strict=True))


def scan(texts: list[bytes], windows: WindowSet) -> Iterator[tuple[int, list[tuple[int, int]], list[tuple[int, int]], set[int]]]:
    """For each text: number of words, hit ranges of words, the same in bytes, items that occur."""
    words = Words(texts, ALNUM)
    hits: list[tuple[int, int, list[int]]] = []
    for size, known in windows.hashes.items():
        grams = words.grams(size)
        at = np.searchsorted(known, grams)
        for k in np.flatnonzero(known[np.minimum(at, len(known) - 1)] == grams).tolist():
            if found := windows.exact[size].get(words_at(words, k, size)):
                hits.append((k, k + size, found))
    hits.sort(key=lambda h: h[:2])
    at = 0
    for i, (a, b) in enumerate(zip(words.first.tolist(), words.last.tolist(), strict=True)):
        ranges: list[list[int]] = []
        items: set[int] = set()
        while at < len(hits) and hits[at][0] < b:
            lo, hi, found = hits[at]
            at += 1
            if hi > b:  # it runs into the next text
                continue
            items.update(found)
            if ranges and lo <= ranges[-1][1]:
                ranges[-1][1] = max(hi, ranges[-1][1])
            else:
                ranges.append([lo, hi])
        base = int(words.text_start[i])
        yield b - a, [(lo - a, hi - a) for lo, hi in ranges], [(int(words.start[lo]) - base, int(words.end[hi - 1]) - base) for lo, hi in ranges], items


_RANGES = "array<struct<first:int,last:int>>"
_OWN, _NAMES = "_lacuna_", ("n_words", "hit_words", "hit_bytes", "items")
_ADDED = f"{_OWN}n_words long, {_OWN}hit_words {_RANGES}, {_OWN}hit_bytes {_RANGES}, {_OWN}items array<string>"
_SETS: dict[str, WindowSet] = {}


def _blocks(benchmark: DataFrame, n: int, block_windows: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of bounded windows; an item of more windows than that is cut into overlapping parts."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").orderBy("item_id", "text").toLocalIterator():
        words = Words(utf8([row["text"]]), ALNUM)
        total = len(words.hash)
        for lo in range(0, max(1, total - n + 1), block_windows):
            hi = min(total, lo + block_windows + n - 1)
            text = words_at(words, lo, hi - lo).decode("utf-8", "surrogatepass") if total else ""
            if block and size + hi - lo > block_windows:
                yield block
                block, size = [], 0
            block.append((row["item_id"], text))
            size += hi - lo
    yield block


def find_benchmark(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents' own columns with n_words, hit_words and hit_bytes (ranges, end exclusive) and items (ids, as strings).

    These take the place of columns of the same name.
    """
    found = _found(docs.select([c for c in docs.columns if c.lower() not in _NAMES]), benchmark, n, block_windows)
    return found.withColumnsRenamed({_OWN + c: c for c in _NAMES})


def _found(docs: DataFrame, benchmark: DataFrame, n: int, block_windows: int) -> DataFrame:
    """All columns of the documents with those of the scan, under names of its own."""
    arrow_limits(docs.sparkSession)
    blocks = _blocks(benchmark, n, block_windows)  # one at a time on the driver
    first, second = next(blocks), next(blocks, None)
    if second is None:
        return _scanned(docs, first, n)
    key = [F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("_lacuna_k1"), F.xxhash64("text").alias("_lacuna_k2"), F.xxhash64(F.lit(7), "text").alias("_lacuna_k3")]
    keys, names = ["_lacuna_k1", "_lacuna_k2", "_lacuna_k3"], [_OWN + c for c in _NAMES]
    parts = (_scanned(docs.select("doc_id", "text"), block, n).select(*key, *names).dropDuplicates(keys) for block in chain((first, second), blocks))
    merged = reduce(DataFrame.unionByName, parts).groupBy(keys).agg(F.max(names[0]).alias(names[0]), *(_union(c) for c in names[1:3]), F.array_distinct(F.flatten(F.collect_list(names[3]))).alias(names[3]))
    return docs.select("*", *key).join(merged, keys, "left").drop(*keys)


def _union(name: str) -> Column:
    """Ranges of all blocks, sorted; ranges that touch or overlap are not yet one."""
    return F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)


def _scanned(docs: DataFrame, items: list[tuple[str, str | None]], n: int) -> DataFrame:
    held, name = docs.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex
    at, names = docs.columns.index("text"), docs.columns
    ranges = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _SETS:  # a worker keeps the set of the last block that it has scanned
            _SETS.clear()
            _SETS[name] = WindowSet(held.value, n)
        windows = _SETS[name]
        for batch in it:
            texts = utf8(batch.column(at).to_pylist())
            rows: list[tuple] = []
            for lo, hi in batches(texts):
                rows += [(w, [{"first": a, "last": b} for a, b in r], [{"first": a, "last": b} for a, b in c], sorted({windows.items[k] for k in found} - {None})) for w, r, c, found in scan(texts[lo:hi], windows)]
            added = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), ranges, ranges, pa.list_(pa.string())))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*names, *(_OWN + c for c in _NAMES)])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, {_ADDED}")


def n_hit(ranges: str = "hit_words") -> Column:
    """Words in the union of ranges that are sorted by their start."""
    step = lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(r["first"], s["end"]))).alias("n"), F.greatest(s["end"], r["last"]).alias("end"))
    return F.aggregate(ranges, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), step, lambda s: s["n"].cast("long"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, mode: str = "documents", n: int = WINDOW) -> DataFrame:
    """Documents without what the benchmark has of them, with the columns they came with.

    mode "documents" drops every hit document; mode "spans" cuts the hit words (from the first to the last character of a
    range) out of the text and keeps the rest.
    """
    found = _found(docs, benchmark, n, BLOCK_WINDOWS)
    if mode == "documents":
        return found.where(F.size(f"{_OWN}hit_words") == 0).select(docs.columns)
    if mode != "spans":
        raise ValueError(f"mode {mode!r}")
    raw = F.encode("text", "utf-8")
    merged = F.aggregate(f"{_OWN}hit_bytes", F.struct(F.lit(0).alias("at"), F.expr("cast(x'' as binary)").alias("out")), lambda s, r: F.struct(F.greatest(s["at"], r["last"]).alias("at"), F.concat(s["out"], F.substring(raw, s["at"] + 1, F.greatest(F.lit(0), r["first"] - s["at"]))).alias("out")), lambda s: F.concat(s["out"], F.substring(raw, s["at"] + 1, F.octet_length("text"))))
    text = F.when(F.size(f"{_OWN}hit_bytes") > 0, F.decode(merged, "utf-8")).otherwise(F.col("text")).alias("text")
    return found.select([text if c == "text" else F.col(c) for c in docs.columns])


