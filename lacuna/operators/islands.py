"""Gaps, islands, runs and spans of series; a span is half-open."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, by: list[str], sample: str = "sample") -> DataFrame:
    """by, start, end, length of the interior runs of samples that a series doesn't have.

    One look ahead on the rows that exist: the missing samples themselves are never made.
    """
    after = F.lead(sample).over(Window.partitionBy(*by).orderBy(sample))
    held = df.select(*by, (F.col(sample) + 1).alias("start"), after.alias("end"))
    return held.where(F.col("end") > F.col("start")).select(*by, "start", "end", (F.col("end") - F.col("start")).alias("length"))


def dense(df: DataFrame, by: list[str], sample: str = "sample") -> DataFrame:
    """Every sample between a series' first and last one; value is null where it has none."""
    bounds = df.groupBy(*by).agg(F.min(sample).alias("lo"), F.max(sample).alias("hi"))
    frame = bounds.select(*by, F.explode(F.sequence("lo", "hi")).alias(sample))
    return frame.join(df, [*by, sample], "left")


def spans(df: DataFrame, by: list[str], status: list[str], sample: str = "sample", breaks: Column | None = None) -> DataFrame:
    """by, start, end, length and status of the maximal runs of consecutive samples with equal status.

    breaks: true on a row that starts a new run whatever its status is.
    """
    w = Window.partitionBy(*by).orderBy(sample)
    new = F.lag(sample).over(w).isNull() | (F.lag(sample).over(w) + 1 != F.col(sample))
    for c in status:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    if breaks is not None:
        new = new | F.coalesce(breaks, F.lit(False))
    marked = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run", *status).agg(F.min(sample).alias("start"), (F.max(sample) + 1).alias("end")).select(*by, *status, "start", "end", (F.col("end") - F.col("start")).alias("length"))


def coverage_violations(df: DataFrame, by: list[str], total: str) -> DataFrame:
    """Spans (start, end) that don't follow the one before, or don't begin at 0 or end at `total`: by, start, rule."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    before, after = F.lag("end").over(w), F.lead("start").over(w)
    rule = F.when(before.isNull() & (F.col("start") != 0), "starts_late").when(before < F.col("start"), "hole").when(before > F.col("start"), "overlap").when(after.isNull() & (F.col("end") != F.col(total)), "ends_early")
    return df.select(*by, "start", rule.alias("rule")).where("rule is not null")


def merged(df: DataFrame, by: list[str]) -> DataFrame:
    """Union of half-open intervals (start, end) that touch or overlap."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (reach.isNull() | (reach < F.col("start"))).cast("int")).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_run")


def in_intervals(samples: DataFrame, intervals: DataFrame, by: list[str], width: int, sample: str = "sample") -> DataFrame:
    """samples with `covered`: whether an interval of the same key has them.

    Intervals are dealt to buckets of `width` samples, so that the join is an equi-join with a residual range and a long
    series is no single group. Repeated samples stay as many as they are.
    """
    whole = merged(intervals, by).where("end > start")
    dealt = whole.select(*by, F.struct("start", "end").alias("_i"), F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))).alias("_b"))
    held = dealt.groupBy(*by, "_b").agg(F.collect_list("_i").alias("_held"))  # apart from each other, so at most `width` in a bucket
    joined = samples.withColumn("_b", F.floor(F.col(sample) / width)).join(held, [*by, "_b"], "left")
    inside = F.exists("_held", lambda i: (F.col(sample) >= i["start"]) & (F.col(sample) < i["end"]))
    return joined.select(*(F.col(c) for c in samples.columns), F.coalesce(inside, F.lit(False)).alias("covered"))
