"""Phrase collocations: n-grams of every language as DataFrame rows, counted, scored by their weakest cut and ranked.

Texts are cut at `[.,;:!?\\x0A-\\x0D]` into pieces and these at blanks and tabs into words, A-Z lower-cased. For each size
from one word to `max_words` the grams of all texts are exploded into rows (lang, phrase, count), aggregated by language and
phrase, and kept from `least` occurrences on. A gram can't occur more often than the two grams of one word less within it, so
only grams whose both parts were kept become rows. Word pairs are by far the most, and hardly any is frequent: their rows are
first 64-bit hashes alone, and only pairs whose hash was counted often enough become rows with text. Hashes that meet can only
raise a count, so nothing that is frequent gets lost, and what counts is the phrases' own number. Tests of hashes read bitmaps
of fixed size (16 MB at most), which let some others pass and stop none that counts: with more frequent grams than they can
tell apart more rows are made, and the results are the same. Each stretch of text adds up its own grams first, so a frequent
phrase sends one row for each, and a hot language is spread over its phrases.

The score of a phrase is the lowest over its cuts of floor(1000 * a * n / (l * r)), with the frequencies of the phrase, of
both sides, and of all words of the language. Products are Decimal(38): exact while 1000 * a * n stays below 10**38.

Rows: a null text has no words; a null language is `und`; repeated rows count again; an empty table or one without phrases
gives no row; other columns are ignored. Ties in score go by frequency, then by the phrase's UTF-8 bytes. A word may be as
long as its text; texts are taken in parts of some four megabytes that end at a piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Bitmap, arrow_limits, materialize, mix

PART = 4 << 20
#: Bits of the bitmap, as a power of two.
BITMAP_LOG = 27
#: Parts in which a language's phrases are ranked before they meet.
SALTS = 64
_SEPARATOR, _WORD = np.zeros(256, bool), np.ones(256, bool)
_SEPARATOR[[*b".,;:!?\n\x0b\x0c\r"]] = True
_WORD[[*b".,;:!?\n\x0b\x0c\r \t"]] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
@dataclass(frozen=True)
class Mining:
    """Sizes of phrases, least frequency, share of a longer phrase that replaces a shorter one, phrases for a language."""

    max_words: int = 5
    least: int = 100
    cover_percent: int = 100
    top: int = 2000


def _parts(raw: np.ndarray) -> Iterator[np.ndarray]:
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(n, lo + PART)
        while hi < n:
            gap = np.flatnonzero(_SEPARATOR[raw[hi : hi + PART]])
            if len(gap):
                hi += int(gap[0]) + 1
                break
            hi = min(n, hi + PART)
        yield raw[lo:hi]
        lo = hi


def _hash(words: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))


def _chain(hashes: list[np.ndarray], seed: np.uint64 | np.ndarray) -> np.ndarray:
    """Hash of a phrase from those of its words."""
    out = np.zeros(len(hashes[0]), np.uint64) + seed
    for h in hashes:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h)
    return out


class Stretch:
    """Words of a stretch of UTF-8 text: their number among the distinct ones, their hash, and where pieces end."""

    def __init__(self, raw: np.ndarray, seed: np.uint64) -> None:
        inside = _WORD[raw]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
        start, end = edges[::2], edges[1::2]
        self.size, self.seed = len(start), seed
        offsets = np.concatenate([[0], np.cumsum(end - start)])
        self.kind, width = (pa.large_binary(), np.int64) if offsets[-1] >= 1 << 31 else (pa.binary(), np.int32)
        listed = pa.Array.from_buffers(self.kind, self.size, [None, pa.py_buffer(offsets.astype(width)), pa.py_buffer(_FOLD[raw[inside]])]).dictionary_encode()
        self.distinct, self.word = listed.dictionary, listed.indices.to_numpy().astype(np.int64)
        self.hash = _hash(self.distinct)[self.word]
        self.piece = np.searchsorted(np.flatnonzero(_SEPARATOR[raw]), start)

    def places(self, n: int) -> np.ndarray:
        """Words from which on n words lie in one piece."""
        at = np.arange(max(0, self.size - n + 1))
        return at if n == 1 else at[self.piece[at] == self.piece[at + n - 1]]

    def hashes(self, at: np.ndarray, n: int) -> np.ndarray:
        return _chain([self.hash[at + k] for k in range(n)], self.seed)

    def passing(self, n: int, parts: Bitmap | None = None, own: Bitmap | None = None) -> np.ndarray:
        """Places of grams of n words whose both parts of n - 1 words, or whose own hash, may be known."""
        at = self.places(n)
        for lo in (0, 1) if parts is not None else ():
            at = at[parts.has(self.hashes(at + lo, n - 1))]
        return at if own is None else at[own.has(self.hashes(at, n))]

    def phrases(self, at: np.ndarray, n: int) -> tuple[pa.Array, np.ndarray]:
        """Distinct phrases of n words at these places, and their counts."""
        key = self.word[at]
        for k in range(1, n):  # places of equal phrases get one number, word after word
            key = np.unique((key << 32) | self.word[at + k], return_inverse=True)[1]
        _, first, count = np.unique(key, return_index=True, return_counts=True)
        words = [self.distinct.take(pa.array(self.word[at[first] + k])) for k in range(n)]
        return (words[0] if n == 1 else pc.binary_join_element_wise(*words, pa.scalar(b" ", self.kind))), count


def _stretches(docs: DataFrame, rows_of, schema: str) -> DataFrame:
    """The record batches that `rows_of` (language, stretch of its text) makes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.dictionary_encode(batch.column(0))
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column(1).filter(pc.equal(langs.indices, code)).cast(pa.large_binary())
                ended = pc.binary_join_element_wise(texts, pa.scalar(b"", pa.large_binary()), pa.scalar(b"\n", pa.large_binary()))
                size, offsets = len(ended), np.frombuffer(ended.buffers()[1], np.int64)[ended.offset :]
                raw = np.frombuffer(ended.buffers()[2], np.uint8)[offsets[0] : offsets[size]]
                seed = np.uint64(xxhash.xxh3_64_intdigest(lang))
                for part in _parts(raw):
                    yield from rows_of(lang, Stretch(part, seed))

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where("text is not null").mapInArrow(run, schema)


def _pairs(docs: DataFrame, words: Bitmap, least: int) -> Bitmap:
    """Hashes of the word pairs that may occur `least` times; words: the frequent ones."""
    held = docs.sparkSession.sparkContext.broadcast(words)

    def rows_of(lang: str, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        found, count = np.unique(stretch.hashes(stretch.passing(2, held.value), 2), return_counts=True)
        yield pa.RecordBatch.from_pydict({"hash": found.view(np.int64), "count": count})

    found = _stretches(docs, rows_of, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    return Bitmap(materialize(found.select("hash"), "pairs"), "hash", BITMAP_LOG)


def _phrases(docs: DataFrame, wanted: list[tuple[int, Bitmap | None, Bitmap | None]], least: int) -> DataFrame:
    """(lang, words, phrase, a) of the frequent phrases; wanted: sizes with what their parts or they themselves must be among.
    With phrases of one word goes a row (0, null) for all words of a language."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def rows_of(lang: str, stretch: Stretch) -> Iterator[pa.RecordBatch]:
        for n, parts, own in held.value:
            if n == 1:
                yield pa.RecordBatch.from_pydict({"lang": [lang], "words": pa.array([0], pa.int32()), "phrase": pa.array([None], pa.string()), "count": [stretch.size]})
            phrase, count = stretch.phrases(stretch.passing(n, parts, own), n)
            for lo in range(0, len(phrase), 1 << 18):
                text = phrase.slice(lo, 1 << 18).cast(pa.string())
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(text), pa.string()), "words": pa.array(np.full(len(text), n, np.int32)), "phrase": text, "count": count[lo : lo + len(text)]})

    rows = _stretches(docs, rows_of, "lang string, words int, phrase string, count long").groupBy("lang", "words", "phrase").agg(F.sum("count").alias("a"))
    return materialize(rows.where((F.col("words") == 0) | (F.col("a") >= least)), "phrases")


def _known(phrases: DataFrame, n: int) -> Bitmap:
    """Hashes of the phrases of n words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            words = np.fromiter((xxhash.xxh3_64_intdigest(w) for t in texts for w in t.split(b" ")), np.uint64).reshape(-1, n)
            seeds = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in langs), np.uint64, len(langs))
            yield pa.RecordBatch.from_pydict({"hash": _chain([words[:, k] for k in range(n)], seeds).view(np.int64)})

    return Bitmap(phrases.where(F.col("words") == n).select("lang", "phrase").mapInArrow(run, "hash long"), "hash", BITMAP_LOG)


def frequent(docs: DataFrame, mining: Mining = Mining()) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, a) of all phrases of 1 to max_words words from `least` occurrences on, and (lang, n): all words."""
    arrow_limits(docs.sparkSession)
    least, most = mining.least, mining.max_words
    single = _phrases(docs, [(1, None, None)], least)
    totals = materialize(single.where("words = 0").select("lang", F.col("a").alias("n")), "languages")  # so that Spark sees how small it is
    found = [single.where("words = 1")]
    if most > 1:
        pairs = _pairs(docs, _known(single, 1), least)
        found.append(_phrases(docs, [(2, None, pairs), (3, pairs, None)][: most - 1], least))
    for n in range(4, most + 1):
        found.append(_phrases(docs, [(n, _known(found[-1], n - 1), None)], least))
    return reduce(DataFrame.unionByName, found), totals


def collocations(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """lang, rank (from 1), phrase, a, l, r, n, score: the first `top` phrases of each language."""
    counts, totals = frequent(docs, mining)
    found = counts.where("words > 1")

    # cuts, with the frequencies of both sides
    word = F.split("phrase", " ", -1)
    side = lambda lo, n: F.array_join(F.slice(word, lo, n), " ")
    cuts = found.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for name, out in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(out)), ["lang", name])
    cuts = cuts.join(totals, "lang")
    exact = lambda name: F.col(name).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)")).withColumn("below", (exact("l") * exact("r")).cast("decimal(38,0)"))
    scored = cuts.withColumn("score", F.expr("above div below")).groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("a").alias("a"), F.first("n").alias("n"))

    # a phrase goes if one with a word more, before or behind it, is about as frequent; longer ones are rarer still
    longer = found.where("words > 2").select("lang", F.col("a").alias("more"), F.explode(F.array(side(F.lit(1), F.col("words") - 1), side(F.lit(2), F.col("words") - 1))).alias("phrase"))
    covered = longer.groupBy("lang", "phrase").agg(F.max("more").alias("more"))
    about = (scored["lang"] == covered["lang"]) & (scored["phrase"] == covered["phrase"]) & (F.lit(100) * covered["more"] >= F.lit(mining.cover_percent) * scored["a"])
    kept = scored.join(covered, about, "left_anti")
    ranked = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    for part in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))], ["lang"]):  # a hot language is ranked in parts first
        order = Window.partitionBy(*part).orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= mining.top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
