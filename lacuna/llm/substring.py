"""Substring dedup by sliding sentence spans.

A text is cut into sentences: at line ends, and after `.`, `!` or `?` followed by white space. Three kinds of runs of
consecutive sentences are taken: from every sentence the shortest one of at least `min_sentences` sentences and
`min_words` words, to every sentence the shortest such one that ends with it, and every single sentence of `min_words`
words. A run depends on its own words alone, so a shared passage gives the same runs wherever it stands, and each sentence
of a passage that long lies in one of its runs: one too near to the passage's end to start a run in it lies in a run that
ends there. Runs of nothing but long sentences say no more than these do and are left out. Runs are hashed (128 bits,
words joined by one blank, case kept) and joined over the whole corpus; the first occurrence, by (doc_id, hash of the text,
place), stays, and every sentence that another occurrence covers is removed, together with the white space after it.

Two passes make the runs. The first counts by half of the hash, with a map-side aggregate, so a run that half the corpus
holds is one row for each map task. The halves found at two places or more become a bitmap that is broadcast; the second
pass sends on only runs that it has, and these are joined by the whole hash, so that a false find changes nothing. Runs of
more than `HOT` places don't meet by hash: their first occurrences come from a map-side minimum and are broadcast, at most
`MOST_HOT` of them, the most frequent ones; the rest takes the join. Within a document a run counts once for each place.

Rows: a null text stays null and has no sentences; rows of equal doc_id and text are one document and get the same
result; a null doc_id sorts last; an empty table gives no rows; other columns are carried along by
`remove_repeats`, whose own columns (n_sentences, n_removed, n_chars_removed) take the place of any of the same name.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bitmap, arrow_limits, materialize, mix

MIN_SENTENCES = 2
MIN_WORDS = 20
#: Places of a run from which on it is hot, and hot runs whose first occurrences (44 bytes) are broadcast.
HOT = 5_000
MOST_HOT = 100_000
_K1, _K2, _COVERED = "_lacuna_k1", "_lacuna_k2", "_lacuna_covered"
_END = re.compile(r"\n|(?<=[.!?])[^\S\n]+")


def sentences(text: str) -> list[tuple[int, int]]:
    """Character ranges of the sentences that have a word, each with the white space up to the next one's start."""
    cuts = [0, *(m.end() for m in _END.finditer(text)), len(text)]
    out: list[tuple[int, int]] = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if text[a:b].strip():
            out.append((a, b))
        elif out:
            out[-1] = (out[-1][0], b)
    return out


def runs(text: str, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes]]:
    """(first sentence, sentence after the last, 16-byte hash) of the runs, in order of their places."""
    words = [text[a:b].split() for a, b in sentences(text)]
    joined = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    n, held, long = len(words), [0, *accumulate(map(len, words))], [0, *accumulate(len(w) >= min_words for w in words)]
    found = {(k, k + 1) for k in range(n) if long[k] < long[k + 1]}
    for k in range(n):
        found.add((k, max(k + min_sentences, bisect_left(held, held[k] + min_words))))
        found.add((min(k + 1 - min_sentences, bisect_right(held, held[k + 1] - min_words) - 1), k + 1))
    good = sorted((a, b) for a, b in found if a >= 0 and b <= n and (b == a + 1 or long[b] - long[a] < b - a))
    return [(a, b, xxhash.xxh3_128_digest(b" ".join(joined[a:b]))) for a, b in good]


def _key() -> list:
    null = F.col("doc_id").isNull()  # apart from the largest doc_id by the second part
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias(_K1), F.when(null, F.xxhash64(F.lit(1), "text")).otherwise(F.xxhash64("text")).alias(_K2)]


def find_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """_K1, _K2 (of the document), _COVERED: ranges of sentences of non-first repeated runs; only documents that have any."""
    arrow_limits(docs.sparkSession)
    names = ("h1", "h2", _K1, _K2, "first", "last")
    keyed = docs.select(*_key(), "text")

    def made(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Both halves of the hashes, rows, first and last."""
        found = [(h, i, a, b) for i, text in enumerate(batch.column(2).to_pylist()) for a, b, h in runs(text or "", min_sentences, min_words)]
        h = np.frombuffer(b"".join(f[0] for f in found), np.int64).reshape(-1, 2)
        at = np.array([f[1:] for f in found], np.int64).reshape(-1, 3)
        return h[:, 0].copy(), h[:, 1].copy(), at[:, 0].copy(), at[:, 1].astype(np.int32), at[:, 2].astype(np.int32)

    def places(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h1, _, rows, first, _ = made(batch)
            k1, k2 = (batch.column(k).to_numpy().view(np.uint64)[rows] for k in (0, 1))
            place = mix(mix(mix(k1) + k2) + first.astype(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(place)], names=["h1", "place"])

    # copies of a row give the same place: the number of places is what counts
    counted = keyed.mapInArrow(places, "h1 long, place long").groupBy("h1").agg(F.min("place").alias("least"), F.max("place").alias("most"), F.count("*").alias("c"))
    often = materialize(counted.where("least < most").select("h1", "c"), "repeated-runs")
    bitmap = docs.sparkSession.sparkContext.broadcast(Bitmap(often, "h1"))
    hot = F.broadcast(materialize(often.where(F.col("c") > HOT).orderBy(F.desc("c"), "h1").limit(MOST_HOT).select("h1"), "hot-runs"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            h1, h2, rows, first, last = made(batch)
            keep = bitmap.value.has(h1)
            of = pa.array(rows[keep])
            yield pa.RecordBatch.from_arrays([pa.array(h1[keep]), pa.array(h2[keep]), batch.column(0).take(of), batch.column(1).take(of), pa.array(first[keep]), pa.array(last[keep])], names=list(names))

    held = materialize(keyed.mapInArrow(run, f"h1 long, h2 long, {_K1} long, {_K2} long, first int, last int"), "runs")
    place = lambda: F.struct(_K1, _K2, "first")
    firsts = lambda rows: rows.groupBy("h1", "h2").agg(F.min(place()).alias("at"))
    usual, frequent = held.join(hot, "h1", "left_anti"), held.join(hot, "h1", "left_semi")
    joined = usual.join(firsts(usual), ["h1", "h2"]).unionByName(frequent.join(F.broadcast(materialize(firsts(frequent), "hot-firsts")), ["h1", "h2"]))
    later = joined.where(place() > F.col("at"))
    return later.groupBy(_K1, _K2).agg(F.array_sort(F.collect_set(F.struct("first", "last"))).alias(_COVERED))


def remove_repeats(docs: DataFrame, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with `text` cut, n_sentences, n_removed (sentences) and n_chars_removed."""
    clash = {"n_sentences", "n_removed", "n_chars_removed"}
    docs = docs.select([c for c in docs.columns if c.lower() not in clash])
    joined = docs.select("*", *_key()).join(find_repeats(docs, min_sentences, min_words), [_K1, _K2], "left").drop(_K1, _K2)
    at, names, carried = docs.columns.index("text"), docs.columns, len(docs.columns)

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts, total, gone, chars = [], [], [], []
            for text, covered in zip(batch.column(at).to_pylist(), batch.column(carried).to_pylist(), strict=True):
                parts = sentences(text or "")
                drop = {k for r in covered or () for k in range(r["first"], r["last"])}
                total.append(len(parts))
                gone.append(len(drop))
                if drop:
                    kept = text[: parts[0][0]] + "".join(text[a:b] for k, (a, b) in enumerate(parts) if k not in drop)
                    chars.append(len(text) - len(kept))
                    text = kept
                else:
                    chars.append(0)
                texts.append(text)
            columns = list(batch.columns[:carried])
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in (total, gone, chars))], names=[*names, "n_sentences", "n_removed", "n_chars_removed"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return joined.mapInArrow(cut, f"{fields}, n_sentences long, n_removed long, n_chars_removed long")
