"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of a text (shares of character kinds, word and line shapes, repetition) are standardised and mapped to
`features` random cosines, which approximate a Gaussian kernel. Ridge scores come from normal equations that every
partition sums up by itself and the driver adds and solves; the matrix has (features + 1)**2 numbers however many rows
there are. The scores are calibrated by isotonic regression (pool adjacent violators) on labelled rows that the ridge
didn't see.

Fitting uses at most `fit_rows` labelled rows, those of the smallest hash of doc_id; this bound is the only one, and every
document is scored from its whole text. Of a doc_id's crc32 modulo 4, 0 and 1 fit the ridge, 3 calibrates, 2 is held out.
Labels, lang, source and doc_id are no inputs.

Rows: a null text is an empty text; repeated rows get equal scores; labels with a null doc_id or quality are left out; a
doc_id with several labels counts with each; without both labels among the fitting rows every score is the share of label
1 (0.5 without labels); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACED, Words, arrow_limits, batches, materialize, mix, utf8

STATISTICS = ["log_words", "log_chars", "upper", "lower", "digit", "space", "symbol", "stop", "comma", "bang", "other_punct", "high", "bar", "word_len", "word_len_sd", "long_words", "one_char_words", "no_letter_words", "upper_words", "symbol_words", "distinct_words", "distinct_pairs", "repeat_5", "adjacent_equal", "log_lines", "dup_lines", "words_per_line", "words_per_stop", "top_word"]


@dataclass(frozen=True)
class Settings:
    features: int = 256
    gamma: float = 0.02
    ridge: float = 1.0
    fit_rows: int = 20_000
    seed: int = 7
    threshold: float = 0.7


def _kinds() -> np.ndarray:
    """Bits of each byte: 1 upper, 2 lower, 4 digit, 8 symbol, 16 stop, 32 comma, 64 bang, 128 other punctuation."""
    out = np.zeros(256, np.uint8)
    for b in range(33, 127):
        c = chr(b)
        out[b] = 1 if c.isupper() else 2 if c.islower() else 4 if c.isdigit() else 8 if c in "#*$%&<>@^~=+_{}[]\\" else 16 if c in ".?" else 32 if c in ",;:" else 64 if c == "!" else 128
    return out


_KIND = _kinds()


def _sums(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[last] - total[first]


def _distinct(groups: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of each group, members of repeated hashes, largest count of one hash."""
    distinct, repeated, top = np.zeros(n), np.zeros(n), np.zeros(n)
    if len(hashes):
        order = np.lexsort((hashes, groups))
        g, h = groups[order], hashes[order]
        new = np.flatnonzero(np.concatenate([[True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])]))
        sizes = np.diff(np.append(new, len(h)))
        np.add.at(distinct, g[new], 1)
        np.add.at(repeated, g[new], np.where(sizes > 1, sizes, 0))
        np.maximum.at(top, g[new], sizes)
    return distinct, repeated, top


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of STATISTICS for each text."""
    n = len(texts)
    words = Words(texts, SPACED)
    raw = np.frombuffer(words.data, np.uint8)
    kind = _KIND[raw]
    ts, te, wf, wl = words.text_start, words.text_end, words.first, words.last
    count = (wl - wf).astype(float)
    some, chars = np.maximum(count, 1), np.maximum(te - ts, 1).astype(float)
    share = lambda mask: _sums(mask, ts, te) / chars
    per_word = lambda values: _sums(values, wf, wl) / some
    length = (words.end - words.start).astype(float)
    of = np.repeat(np.arange(n), wl - wf)
    inside = lambda mask: _sums(mask, words.start, words.end)
    high = raw >= 0x80
    upper, lower, symbol = inside(kind == 1), inside(kind == 2), inside(kind == 8)
    letters = upper + lower + inside(high)
    mean = per_word(length)
    distinct, _, top = _distinct(of, words.hash, n)
    same_text = of[1:] == of[:-1]
    pairs, _, _ = _distinct(of[1:][same_text], words.grams(2)[same_text], n)
    five = words.grams(5)
    ok = of[4:] == of[: len(of) - 4] if len(of) >= 5 else np.zeros(0, bool)
    _, again, _ = _distinct(of[: len(five)][ok], five[ok], n)
    equal = np.concatenate([(words.hash[1:] == words.hash[:-1]) & same_text, [False]]) if len(of) else np.zeros(0, bool)
    lines, dup = _lines(words, raw, of, n)
    stops = _sums(kind == 16, ts, te)
    columns = [
        np.log1p(count), np.log1p(te - ts), share(kind == 1), share(kind == 2), share(kind == 4), share((raw == 32) | ((raw >= 9) & (raw <= 13))), share(kind == 8), share(kind == 16), share(kind == 32), share(kind == 64), share(kind == 128), share(high), share(raw == 0x7C),
        mean, np.sqrt(np.maximum(per_word(length**2) - mean**2, 0)), per_word(length > 20), per_word(length == 1), per_word(letters == 0), per_word((upper > 0) & (lower == 0) & (letters > 1)), per_word(symbol > 0),
        distinct / some, pairs / np.maximum(count - 1, 1), again / np.maximum(count - 4, 1), per_word(equal), np.log1p(lines), dup / np.maximum(lines, 1), count / np.maximum(lines, 1), count / np.maximum(stops, 1), top / some,
    ]
    return np.stack(columns, axis=1)


def _lines(words: Words, raw: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those that are equal (as words) to another one of the text."""
    if not len(of):
        return np.zeros(n), np.zeros(n)
    breaks = np.cumsum(raw == 10)
    line = breaks[words.start]
    new = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
    at = np.arange(len(of)) - np.repeat(new, np.diff(np.append(new, len(of))))
    hashes = mix(np.add.reduceat(mix(words.hash + at.astype(np.uint64)), new))
    lines = np.bincount(of[new], minlength=n).astype(float)
    distinct, _, _ = _distinct(of[new], hashes, n)
    return lines, lines - distinct


def isotonic(scores: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, value) of the non-decreasing least-squares fit; equal scores are one block."""
    knots, inverse = np.unique(scores, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    value = np.bincount(inverse, weights=labels) / weight
    blocks: list[list[float]] = []
    for k, (v, w) in enumerate(zip(value, weight, strict=True)):
        blocks.append([v, w, k])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, _ = blocks.pop()
            v1, w1, start = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, start])
    starts = [int(b[2]) for b in blocks] + [len(knots)]
    x = np.concatenate([[knots[a], knots[b - 1]] for a, b in zip(starts[:-1], starts[1:], strict=True)])
    return x, np.repeat([b[0] for b in blocks], 2)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phase: np.ndarray
    beta: np.ndarray | None
    knots: tuple[np.ndarray, np.ndarray]
    constant: float = 0.5

    def fourier(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ self.weights + self.phase
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.fourier(stats) @ self.beta

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated score; within a flat step the uncalibrated score adds a millionth, so that ranks are kept."""
        if self.beta is None:
            return np.full(len(stats), self.constant)
        raw = self.raw(stats)
        return np.clip(np.interp(raw, *self.knots) * (1 - 1e-6) + 1e-6 / (1 + np.exp(-raw)), 0, 1)


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4


def _statistics_of(docs: DataFrame, carried: list[str]) -> DataFrame:
    """The carried columns with stats, an array of STATISTICS."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = utf8(batch.column(len(carried)).to_pylist())
            rows = [statistics(texts[lo:hi]) for lo, hi in batches(texts)]
            flat = np.concatenate(rows) if rows else np.zeros((0, len(STATISTICS)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carried)], pa.array(list(flat), pa.list_(pa.float64()))], names=[*carried, "stats"])

    return docs.select(*carried, "text").mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in carried) + ", stats array<double>")


def fit(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """The model; labels: doc_id, quality."""
    arrow_limits(docs.sparkSession)
    rng = np.random.default_rng(settings.seed)
    size = len(STATISTICS)
    weights = rng.normal(0, np.sqrt(2 * settings.gamma), (size, settings.features))
    phase = rng.uniform(0, 2 * np.pi, settings.features)
    key = F.col("doc_id").cast("long")
    chosen = labels.select(key.alias("doc_id"), F.col("quality").cast("int").alias("label")).where((remainder(F.col("doc_id")) != 2) & F.col("label").isin(0, 1)).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(settings.fit_rows)
    ids = F.broadcast(chosen)  # at most fit_rows rows
    rows = materialize(_statistics_of(docs.select(key.alias("doc_id"), "text").join(ids, "doc_id").select("doc_id", "label", "text"), ["doc_id", "label"]), "labelled")
    rows = rows.coalesce(16)
    moments = rows.select(*(F.avg(F.col("stats")[k]).alias(f"m{k}") for k in range(size)), *(F.stddev_pop(F.col("stats")[k]).alias(f"s{k}") for k in range(size)), F.avg("label").alias("rate"), F.count_distinct("label").alias("kinds")).first()
    if (moments["kinds"] or 0) < 2:
        return Model(np.zeros(size), np.ones(size), weights, phase, None, (np.zeros(1), np.zeros(1)), 0.5 if moments["rate"] is None else moments["rate"])
    mean = np.array([moments[f"m{k}"] for k in range(size)])
    scale = np.array([moments[f"s{k}"] for k in range(size)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1), weights, phase, None, (np.zeros(1), np.zeros(1)))
    width = settings.features + 1

    def normal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = np.zeros((width, width)), np.zeros(width)
        for batch in it:
            x = model.fourier(np.array(batch.column("stats").to_pylist()).reshape(-1, size))
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            a += x.T @ x
            b += x.T @ y
        yield pa.RecordBatch.from_pydict({"a": [a.tobytes()], "b": [b.tobytes()]}, pa.schema([("a", pa.binary()), ("b", pa.binary())]))

    ridge_rows, held_rows = rows.where(remainder(F.col("doc_id")) < 2), rows.where(remainder(F.col("doc_id")) == 3)
    a, b = np.zeros((width, width)), np.zeros(width)
    for part in ridge_rows.mapInArrow(normal, "a binary, b binary").toLocalIterator():
        a += np.frombuffer(part["a"]).reshape(width, width)
        b += np.frombuffer(part["b"])
    penalty = np.eye(width) * settings.ridge
    penalty[-1, -1] = 1e-9
    model.beta = np.linalg.solve(a + penalty, b)
    calibration = held_rows.select("stats", "label").toPandas()  # at most fit_rows rows
    if calibration.empty:
        model.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    else:
        model.knots = isotonic(model.raw(np.array(calibration["stats"].tolist())), calibration["label"].to_numpy(float))
    return model


def score(docs: DataFrame, model: Model, threshold: float = Settings.threshold) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    arrow_limits(docs.sparkSession)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = utf8(batch.column(1).to_pylist())
            found = [model.score(statistics(texts[lo:hi])) for lo, hi in batches(texts)]
            flat = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(flat), pa.array((flat >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    out = docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
