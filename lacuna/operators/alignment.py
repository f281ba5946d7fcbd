"""Aligned leads of a run's candidates: one pair table that the disagreement penalty, trust and uncertainty read.

Leads are compared only within a run and what else `by` names (crop, layout, lead), as competing extractions of one source;
a run has few candidates (the plan's budget), so the pairs grow with the runs. A pair is searched once, the smaller id being
the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import gates
from lacuna.plans import policy

from .grouped import searched
from .quality import both_ways


def dense(df: DataFrame, by: list[str], ident: str) -> DataFrame:
    """by, ident, lo, values: an array from the first to the last sample of all of `by`, null where a sample is missing.

    Of repeated samples the smallest value counts.
    """
    span = df.groupBy(*by).agg(F.min("sample").alias("lo"), F.max("sample").alias("hi"))
    entries = F.array_sort(F.collect_list(F.struct("sample", "value")))
    held = df.where("value is not null").groupBy(*by, ident).agg(entries.alias("e")).join(span, by)
    before = lambda k: F.when(k == 0, F.col("lo") - 1).otherwise(F.get("e", k - 1)["sample"])
    hole = lambda n: F.array_repeat(F.lit(None).cast("double"), n.cast("int"))
    filled = F.flatten(F.transform("e", lambda x, k: F.when(x["sample"] == before(k), hole(F.lit(0))).otherwise(F.concat(hole(x["sample"] - before(k) - 1), F.array(x["value"])))))
    return held.select(*by, ident, "lo", F.concat(filled, hole(F.col("hi") - F.element_at("e", -1)["sample"])).alias("values"))


def pair_table(leads: DataFrame, by: list[str], ident: str) -> DataFrame:
    """by, a, b (a < b), scale, shift, offset, rmse of all pairs of candidates; leads: by, ident, values (array).

    scale, shift, offset and rmse are null where no hypothesis has enough samples, and where `values` is null.
    """
    keyed = leads.where(F.col("values").isNotNull()).select(*by, ident, "values")
    left, right = keyed.select(*by, F.col(ident).alias("a"), F.col("values").alias("va")), keyed.select(*by, F.col(ident).alias("b"), F.col("values").alias("vb"))
    return searched(left.join(right, by).where("a < b"), by)


def penalties(pairs: DataFrame, by: list[str], weight: float = policy.DISAGREEMENT_WEIGHT) -> DataFrame:
    """by, candidate, penalty, compared: the rounded weight times the median error over all leads and peers; 0 without any."""
    middle = F.percentile(F.when(F.col("rmse").isNotNull(), F.col("rmse")), F.lit(0.5))
    return both_ways(pairs).groupBy(*by, F.col("a").alias("candidate")).agg(F.coalesce(gates.js_round(F.round(middle * weight, 6)).cast("long"), F.lit(0).cast("long")).alias("penalty"), F.count("rmse").alias("compared"))


def affine(values: Column, at: Column) -> Column:
    """The value at a place between samples; null outside and where a neighbour is missing."""
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    left, right, part = F.get(values, low), F.get(values, high), at - F.floor(at)
    return F.when((low >= 0) & (high < F.size(values)), F.when(low == high, left).otherwise(left * (1 - part) + right * part))


def aligned_values(leads: DataFrame, pairs: DataFrame, by: list[str], ident: str) -> DataFrame:
    """by, a, b, place, value: b's samples at the reference's places (from 0), less the offset; pairs without a match are left out."""
    side = lambda name, out: leads.select(*by, F.col(ident).alias(name), F.col("values").alias(out))
    met = pairs.where("rmse is not null").join(side("a", "va"), [*by, "a"]).join(side("b", "vb"), [*by, "b"])
    center = (F.size("va") - 1) / 2
    each = met.select(*by, "a", "b", "scale", "shift", "offset", "vb", center.alias("c"), F.explode(F.sequence(F.lit(0), F.size("va") - 1)).alias("place"))
    value = affine(F.col("vb"), F.col("c") + (F.col("place") - F.col("c")) * F.col("scale") + F.col("shift")) - F.col("offset")
    return each.select(*by, "a", "b", "place", value.alias("value"))


def spreads(leads: DataFrame, pairs: DataFrame, by: list[str], ident: str, limit: float = policy.DISAGREEMENT) -> DataFrame:
    """by, place, reference, candidates, spread, status: how far the aligned peers of a group's first candidate lie apart.

    The reference itself counts as a candidate; status is `missing` without a value of the reference, else
    `uncertain_candidate_disagreement` beyond the limit, else `observed`.
    """
    first = leads.groupBy(*by).agg(F.min(ident).alias("a"))
    own = leads.join(first.withColumnRenamed("a", ident), [*by, ident]).select(*by, F.col(ident).alias("a"), F.posexplode("values").alias("place", "value"))
    peers = aligned_values(leads, pairs.join(first, [*by, "a"], "left_semi"), by, ident).select(*by, "a", "place", "value")
    both = own.select("*", F.lit(True).alias("own")).unionByName(peers.select("*", F.lit(False).alias("own")))
    grouped = both.groupBy(*by, F.col("a").alias("reference"), "place").agg(F.count("value").alias("candidates"), (F.max("value") - F.min("value")).alias("spread"), F.max(F.col("own") & F.col("value").isNotNull()).alias("held"))
    status = F.when(~F.col("held"), "missing").when(F.col("spread") > limit, "uncertain_candidate_disagreement").otherwise("observed")
    return grouped.select(*by, "reference", "place", "candidates", "spread", status.alias("status"))
