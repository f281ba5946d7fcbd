"""Row predicates and scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.plans import policy


def clamp(x: Column, lo, hi) -> Column:
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def finite(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def unit_fraction(x: Column) -> Column:
    return F.coalesce(finite(x).between(0.0, 1.0), F.lit(False))


def positive(x: Column) -> Column:
    return F.coalesce(finite(x) > 0, F.lit(False))


def js_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def least_scorable(n: Column) -> Column:
    """min(n, max(20, ceil(0.8 n)))."""
    return F.least(n, F.greatest(F.lit(policy.MIN_SAMPLES), F.ceil(n * F.lit(policy.SCORABLE))))


def least_complete(n: Column) -> Column:
    return F.least(n, F.greatest(F.lit(policy.MIN_SAMPLES), F.ceil(n * F.lit(policy.PUBLISHABLE))))


def covers(have: Column, expected: Column, share: float) -> Column:
    return have >= F.ceil(expected * F.lit(share))


def scorable(expected: Column, have: Column, flat: Column) -> Column:
    return (expected > 0) & (have >= least_scorable(expected)) & ~flat


def reviewable(expected: Column, have: Column, outside: Column) -> Column:
    return covers(have, expected, policy.REVIEWABLE) & (outside == 0)


def candidate_score(**parts: Column) -> Column:
    """Weighted sum of the named penalties."""
    total = F.lit(0.0)
    for name, part in parts.items():
        total = total + part * F.lit(float(policy.SCORE_WEIGHTS.get(name, 1)))
    return total


def publication_rank(score: Column, warning_penalty: Column) -> Column:
    return score - warning_penalty + warning_penalty * F.lit(policy.WARNING_WEIGHT)


def first_reason(*rules: tuple[str, Column]) -> Column:
    """Name of the first rule that holds, null if none does."""
    out = F.when(rules[0][1], F.lit(rules[0][0]))
    for name, rule in rules[1:]:
        out = out.when(rule, F.lit(name))
    return out


def reasons(*rules: tuple[str, Column]) -> Column:
    """Names of all rules that hold, in their order."""
    return F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules)), lambda x: x.isNotNull())


def status_of_sample(annotated: Column, missing: Column, spread: Column, limit: float = policy.DISAGREEMENT) -> Column:
    """Five-way status; annotation comes before missing, missing before disagreement."""
    apart = F.coalesce(spread > limit, F.lit(False))
    return F.when(annotated & apart & ~missing, "uncertain_annotation_and_disagreement").when(annotated, "uncertain_annotation").when(missing, "missing").when(apart, "uncertain_candidate_disagreement").otherwise("observed")


def capture_checks(**values: tuple[Column, float]) -> Column:
    """Array of (name, status): warning where a value is below its limit."""
    return F.array(*(F.struct(F.lit(name).alias("name"), F.when(v < limit, "warning").otherwise("pass").alias("status")) for name, (v, limit) in values.items()))
