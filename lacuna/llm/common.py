"""Shared pieces of the text operators: table access, shared-folder tables and a vectorised word hasher.

The word hasher works on UTF-8 bytes with numpy: one lookup table decides which bytes belong to a word and folds A-Z to
a-z, so a batch of documents is cut into words and every word hashed without a Python loop. Long inputs are processed in
pieces of about a megabyte, cut at a non-word byte, so that memory follows the number of words and not of characters.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIECE = 1 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_BASE = 0x9E3779B97F4A7C15


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    Where none is configured, a session in one process (tests) gets a temporary one; on a cluster that is an error, since
    each executor would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jdir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if jdir.isDefined():
            return jdir.get()
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lacuna-shared-')}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


def made() -> int:
    """A mark for `remove`: how many tables this process has written so far."""
    return len(_MADE)


def remove(spark: SparkSession, since: int, keep: DataFrame) -> None:
    """Delete the tables written since a mark, but for those that `keep` reads; frames that read the others end here."""
    needed = {f.rsplit("/", 1)[0].rstrip("/") for f in keep.inputFiles()}
    for path in [p for p in _MADE[since:] if not any(n.endswith(p.rsplit("/", 1)[1]) for n in needed)]:
        _MADE.remove(path)
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Bitmap:
    """Which 64-bit hashes may be in a column: about 16 bits for each of them, 64 MB at most, so that beyond some 30 million
    hashes more of the others pass by chance. Spark sets the bits; the driver puts the words together."""

    def __init__(self, keys: DataFrame, name: str, most: int = 29) -> None:
        self.log = min(max(20, (16 * keys.count()).bit_length()), most)
        bit = F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(`{name}`, {64 - self.log}) & 63 as int)))")
        word = keys.groupBy(F.shiftrightunsigned(name, 70 - self.log).alias("word")).agg(bit.alias("bits")).toArrow()
        self.words = np.zeros(1 << (self.log - 6), np.uint64)
        self.words[word.column("word").to_numpy()] = word.column("bits").to_numpy().view(np.uint64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.view(np.uint64) >> np.uint64(64 - self.log)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3."""
    x = x ^ (x >> np.uint64(33))
    x = x * _M1
    x = x ^ (x >> np.uint64(33))
    x = x * _M2
    return x ^ (x >> np.uint64(33))


_POW = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(255, _BASE, np.uint64)]))


def powers(n: int) -> np.ndarray:
    """_BASE to the power 0..n-1, modulo 2**64."""
    global _POW
    if len(_POW) < n:
        _POW = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_POW)), _BASE, np.uint64)]))
    return _POW[:n]


class Alphabet:
    """Which bytes belong to words. Bytes of value 0x80 and more always do; A-Z is folded to a-z."""

    def __init__(self, is_word) -> None:
        codes = range(256)
        self.word = np.array([b >= 0x80 or bool(is_word(b)) for b in codes])
        self.fold = np.array([b + 33 if 65 <= b <= 90 else b + 1 for b in codes], np.uint64)


#: `[^\x20\x09-\x0D]+`
SPACED = Alphabet(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z has been folded
ALNUM = Alphabet(lambda b: 48 <= b <= 57 or 97 <= b <= 122 or 65 <= b <= 90)


class Words:
    """Words of a list of UTF-8 texts: hash, byte start and end in `data`, and the range of words of each text."""

    def __init__(self, texts: list[bytes], alphabet: Alphabet) -> None:
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.text_end = np.cumsum(lens + 1) - 1
        self.text_start = self.text_end - lens
        parts = [_hash_piece(raw, lo, hi, alphabet) for lo, hi in _pieces(raw, alphabet)]
        join = lambda k, kind: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind)
        self.hash, self.start, self.end = join(0, np.uint64), join(1, np.int64), join(2, np.int64)
        self.first = np.searchsorted(self.start, self.text_start)
        self.last = np.searchsorted(self.start, self.text_end)

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word on; runs that leave a text are for the caller to skip."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64)
        m, p = len(h) - n + 1, powers(n + 1)
        out = np.zeros(m, np.uint64)
        for k in range(n):
            out += h[k : k + m] * p[k + 1]
        return mix(out)


def _pieces(raw: np.ndarray, alphabet: Alphabet) -> Iterator[tuple[int, int]]:
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + PIECE)
        while hi < n:  # to the next byte outside words
            gap = np.flatnonzero(~alphabet.word[raw[hi : hi + PIECE]])
            if len(gap):
                hi += int(gap[0])
                break
            hi = min(n, hi + PIECE)
        yield lo, hi
        lo = hi


def _hash_piece(raw: np.ndarray, lo: int, hi: int, alphabet: Alphabet):
    piece = raw[lo:hi]
    inside = alphabet.word[piece]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    lens = end - start
    values = alphabet.fold[piece[inside]]
    offset = np.concatenate([[0], np.cumsum(lens)[:-1]])
    at = np.arange(len(values)) - np.repeat(offset, lens)
    values = values * powers(int(lens.max()) + 1)[at]
    return mix(np.add.reduceat(values, offset) + lens.astype(np.uint64)), start + lo, end + lo


def batches(texts: list, limit: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` characters together; one long text makes a range of its own."""
    lo = size = 0
    for k, t in enumerate(texts):
        n = len(t) if t is not None else 0
        if k > lo and size + n > limit:
            yield lo, k
            lo, size = k, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def utf8(texts) -> list[bytes]:
    """Texts as bytes, a null as an empty text."""
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def arrow_limits(spark: SparkSession) -> None:
    """Arrow batches by bytes besides rows, so that long texts don't make one batch of gigabytes.

    The frame that is returned runs later, so the session keeps the setting; one that the caller has made stays.
    """
    if _BATCH_BYTES not in spark.conf.getAll:
        spark.conf.set(_BATCH_BYTES, "24m")
