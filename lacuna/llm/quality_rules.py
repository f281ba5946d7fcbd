"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a condition that rejects a document. On a sample of all partitions each rule's cost (seconds a row) and
selectivity (share of rejected rows) are measured, and the rules are ordered by rejection per cost. The cascade is one
CASE expression in that order: a document that an early rule rejects never pays for the later ones. The order changes the
speed and the name of the rule that is reported, never which documents are kept.

Words are `[^\\x20\\x09-\\x0D]+`. n_repeat_words counts the words in five-word windows that occur twice or more in the
text: window hashes are compared by sorting within the row, so no row is exploded or shuffled.

Rows: a null or empty text has no words and fails the base rule; repeated rows are judged each by itself; nulls in other
columns don't matter; an empty table gives no rows; other columns, clashing names included, are carried by `keep_good`.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = r"[\x20\x09-\x0D]"
WINDOW = 5
SAMPLE_ROWS = 256
REPEATS = 8
#: Repeated lines that a document may have for each hundred lines.
DUP_LINE_PERCENT = 60


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once in the row, and only where the whole expression is."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, f"{SPACE}+"))


def word_chars(words: Column) -> Column:
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")), F.lit(0)).cast("long")


def n_dup_lines(text: Column) -> Column:
    def count(lines: Column) -> Column:
        return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")

    return F.when(F.instr(text, "\n") > 0, let(F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]")), count)).otherwise(F.lit(0).cast("long"))


def n_repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words in windows that the text has twice or more, the first one included."""

    def covered(places: Column) -> Column:  # ascending starts of repeated windows
        step = F.transform(places, lambda p, j: F.least(F.lit(window), F.coalesce(F.get(places, j + 1) - p, F.lit(window))))
        return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(grams: Column) -> Column:
        ranked = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda s, e, j: F.coalesce(F.get(s, j - 1)["g"] == e["g"], F.lit(False)) | F.coalesce(F.get(s, j + 1)["g"] == e["g"], F.lit(False))
        places = let(ranked, lambda s: F.array_sort(F.transform(F.filter(s, lambda e, j: same(s, e, j)), lambda e: e["i"])))
        return F.when(F.size(F.array_distinct(grams)) < F.size(grams), let(places, covered)).otherwise(F.lit(0).cast("long"))

    def windows(hashes: Column) -> Column:
        starts = F.slice(hashes, 1, F.size(hashes) - (window - 1))
        return F.transform(starts, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + k) for k in range(1, window))))

    # fewer words than two windows' starts can't repeat one
    return F.when(F.size(words) > window, let(let(F.transform(words, lambda w: F.xxhash64(w)), windows), repeated)).otherwise(F.lit(0).cast("long"))


@dataclass(frozen=True)
class Rule:
    """reject: true where the document goes; built from the columns text and words."""

    name: str
    reject: Callable[[Column, Column], Column]


def base_failed(n_words: Column, repeat_words: Column) -> Column:
    return (n_words < 10) | (100 * repeat_words > 20 * n_words)


def _share(part: Column, words: Column, percent: int) -> Column:
    return part * 100 > F.size(words) * percent


RULES = [
    Rule("few_words", lambda text, words: F.size(words) < 10),
    Rule("repeat_words", lambda text, words: 100 * n_repeat_words(words) > 20 * F.size(words)),
    Rule("symbols", lambda text, words: _share(n_symbols(text), words, 30)),
    Rule("dup_lines", lambda text, words: F.size(F.split(F.coalesce(text, F.lit("")), "\n", -1)) * DUP_LINE_PERCENT < n_dup_lines(text) * 100),
    Rule("upper_case", lambda text, words: F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{Lu}]+", "")) * 100 > word_chars(words) * 40),
    Rule("word_length", lambda text, words: (word_chars(words) < F.size(words) * 2) | (word_chars(words) > F.size(words) * 25)),
]


def measured(docs: DataFrame, rules: list[Rule], rows: int = SAMPLE_ROWS) -> list[tuple[str, float, float]]:
    """(rule, seconds a row, share rejected) on a sample of about `rows` documents from all partitions, written once.

    The sample is read `REPEATS` times over in one task, so that a rule's work outweighs a job's start-up, and the time of
    the same job without a rule is taken off; of two runs the shorter one counts.
    """
    total = docs.count()
    if not total or not rows:
        return [(r.name, 1.0, 0.0) for r in rules]
    sample = materialize(docs.select(F.col("text").cast("string").alias("text")).sample(min(1.0, rows / total), 11).coalesce(1), "rule-sample")
    held = sample.select("text", words_of(F.col("text")).alias("words"))
    again = held.crossJoin(docs.sparkSession.range(REPEATS).coalesce(1)).coalesce(1)
    share = held.select(*(F.avg(F.coalesce(r.reject(F.col("text"), F.col("words")), F.lit(True)).cast("int")).alias(r.name) for r in rules)).first()

    def seconds(value: Column) -> float:
        took = []
        for _ in range(2):
            began = time.perf_counter()
            again.agg(F.sum(value)).first()
            took.append(time.perf_counter() - began)
        return min(took)

    base, n = seconds(F.size("words")), max(1, sample.count()) * REPEATS
    return [(r.name, max(seconds(F.coalesce(r.reject(F.col("text"), F.col("words")), F.lit(True)).cast("int")) - base, 1e-4) / n, share[r.name] or 0.0) for r in rules]


def ordered(rules: list[Rule], found: list[tuple[str, float, float]]) -> list[Rule]:
    gain = {name: (-share / max(seconds, 1e-12), seconds, name) for name, seconds, share in found}
    return sorted(rules, key=lambda r: gain[r.name])


def first_failed(rules: list[Rule], text: Column, words: Column) -> Column:
    """Name of the first rule that rejects, null if none does."""
    out = F.when(F.coalesce(rules[0].reject(text, words), F.lit(True)), F.lit(rules[0].name))
    for r in rules[1:]:
        out = out.when(F.coalesce(r.reject(text, words), F.lit(True)), F.lit(r.name))
    return out


def keep_good(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with the columns they came with."""
    plan = ordered(rules, measured(docs, rules, sample_rows))
    text = F.col("text").cast("string")
    # words are made once in the row: a column of them would be put in place of each of its uses in the condition
    return docs.where(let(words_of(text), lambda words: first_failed(plan, text, words)).isNull())


def judged(docs: DataFrame, rules: list[Rule] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, rule (the one that rejects)."""
    plan = [r for r in ordered(rules, measured(docs, rules, sample_rows)) if r.name not in ("few_words", "repeat_words")]
    text, words = F.col("text"), F.col("words")
    held = docs.selectExpr("cast(doc_id as long) as doc_id", "text").withColumn("words", words_of(text))
    counted = held.select("doc_id", "text", "words", F.size(words).cast("long").alias("n_words"), word_chars(words).alias("word_chars"), n_symbols(text).alias("n_symbols"), F.coalesce(n_dup_lines(text), F.lit(0).cast("long")).alias("n_dup_lines"), n_repeat_words(words).alias("n_repeat_words"))
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    rule = F.when(failed, F.lit("base")).otherwise(first_failed(plan, text, words))
    out = counted.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), rule.alias("rule"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rule").isNull().alias("kept"), "rule")
