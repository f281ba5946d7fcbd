"""Traced paths: source times, canonical signals, review flags and composed pages.

A path is rows of its key, x (column), y and valid; neighbours are joined if both are valid and their columns touch. Work is
by windows over one path, so no path is collected; a path has as many rows as its image has columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.operators import resample


def between(df: DataFrame, by: list[str], at: str, value: str, joined: str, last: Column) -> DataFrame:
    """by, target, value: linear values at the whole positions 0 to `last` between joined neighbours.

    `at` is a position that grows along the path and `joined` says that a row continues its predecessor. A target on a row
    itself belongs to the pair that begins there, or to the pair that ends there where nothing follows.
    """
    w = Window.partitionBy(*by).orderBy(at)
    end, go_on = F.lead(at).over(w), F.lead(joined, 2, False).over(w)
    pairs = df.select("*", end.alias("_end"), F.lead(value).over(w).alias("_to"), F.lead(joined).over(w).alias("_next"), go_on.alias("_more")).where("_next")
    first = F.greatest(F.ceil(at), F.lit(0))
    final = F.least(F.when(F.col("_more"), F.ceil("_end") - 1).otherwise(F.floor("_end")), last)
    targets = pairs.where(first <= final).withColumn("target", F.explode(F.sequence(first.cast("long"), final.cast("long"))))
    part = (F.col("target") - F.col(at)) / (F.col("_end") - F.col(at))
    return targets.select(*by, "target", (F.col(value) + (F.col("_to") - F.col(value)) * part).alias("value"))


def linked(path: DataFrame, by: list[str], ordered: str = "x") -> DataFrame:
    """The valid rows with `joined`: the column before belongs to the path and is valid."""
    w = Window.partitionBy(*by).orderBy(ordered)
    return path.where("valid").withColumn("joined", F.coalesce(F.lag(ordered).over(w) == F.col(ordered) - 1, F.lit(False)))


def canonical(path: DataFrame, by: list[str], start: Column, width: Column, samples: int, pixels_per_mm: Column, gain: Column) -> DataFrame:
    """by, target, value (microvolt): a panel's path on its canonical samples, around the median of its valid rows."""
    base = path.where("valid").groupBy(*by).agg(F.percentile("y", F.lit(0.5)).alias("_base"))
    placed = linked(path, by).withColumn("_at", (F.col("x") - start) / F.greatest(width - 1, F.lit(1)) * (samples - 1)).withColumn("_scale", 1000.0 / gain / pixels_per_mm)
    made = between(placed.join(base, by).withColumn("_uv", -(F.col("y") - F.col("_base")) * F.col("_scale")), by, "_at", "_uv", "joined", F.lit(samples - 1))
    return made


def timed(path: DataFrame, ranges: DataFrame, by: list[str], seconds: float) -> DataFrame:
    """The path with `time`: columns are dealt to the row's ranges (by.., column, left, right) and each lasts `seconds`; rows outside all are left out."""
    held = path.join(ranges, by).where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")))
    return held.withColumn("time", F.col("column") * seconds + (F.col("x") - F.col("left")) / (F.col("right") - F.col("left")) * seconds).drop("column", "left", "right")


def review_flags(samples: DataFrame, path: DataFrame, by: list[str], rate: int) -> DataFrame:
    """The samples (by.., sample, value) with `review`: a value that lies on a connection of a flagged row.

    path: by.., x, time, valid, flagged. Flagged rows stay valid; a connection is one of two joined rows.
    """
    w = Window.partitionBy(*by).orderBy("x")
    ends = linked(path, by).select(*by, "x", F.lag("time").over(w).alias("a"), F.col("time").alias("b"), "joined", (F.col("flagged") | F.lag("flagged", 1, False).over(w)).alias("touched")).where("joined and touched")
    covered = ends.select(*by, F.ceil(F.col("a") * rate).alias("lo"), F.floor(F.col("b") * rate).alias("hi")).where("lo <= hi").select(*by, F.explode(F.sequence("lo", "hi")).alias("sample")).distinct()
    marked = samples.join(covered.withColumn("_hit", F.lit(True)), [*by, "sample"], "left")
    return marked.select(*samples.columns, (F.col("value").isNotNull() & F.coalesce("_hit", F.lit(False))).alias("review"))


def composed(sides: DataFrame, by: list[str], wanted: Column, offset: Column, n_source: int, n: int) -> DataFrame:
    """by, sample, value of a page: each lead's wanted side, stretched from n_source to n samples and moved by the offset.

    sides: by.. (with the lead), side, sample, value; offset is an expression on `by`.
    """
    made = resample.resample_runs(sides.where(wanted).select(*by, "sample", "value"), by, (n - 1) / (n_source - 1))
    return made.where(F.col("target").between(0, n - 1)).select(*by, (F.col("target") + offset).alias("sample"), "value")


def rhythm(path: DataFrame, ranges: DataFrame, by: list[str], samples: int, pixels_per_mm: Column, gain: Column) -> DataFrame:
    """by, target, value: a path over several touching ranges (by.., part, left, right) of a page, each with `samples` samples.

    All parts share the baseline of the whole path, so nothing steps where they meet.
    """
    base = path.where("valid").groupBy(*by).agg(F.percentile("y", F.lit(0.5)).alias("_base"))
    parts = linked(path, by).join(ranges, by).where((F.col("x") >= F.col("left")) & (F.col("x") < F.col("right")))
    w = Window.partitionBy(*by, "part").orderBy("x")
    at = (F.col("x") - F.col("left")) / F.greatest(F.col("right") - F.col("left") - 1, F.lit(1)) * (samples - 1)
    uv = -(F.col("y") - F.col("_base")) * (1000.0 / gain / pixels_per_mm)
    held = parts.join(base, by).withColumn("joined", F.col("joined") & F.lag("x").over(w).isNotNull()).withColumn("_at", at).withColumn("_uv", uv)
    made = between(held, [*by, "part"], "_at", "_uv", "joined", F.lit(samples - 1))
    return made.select(*by, (F.col("part") * samples + F.col("target")).alias("target"), "value")


def moved_events(events: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """by, x: events (by.., x) inside a frame's source interval, on its destination (by.., start, end, to, to_end); each place once."""
    inside = events.join(frames, by).where((F.col("x") >= F.col("start")) & (F.col("x") < F.col("end")) & (F.col("end") - F.col("start") >= 2) & (F.col("to_end") - F.col("to") >= 2))
    at = F.col("to") + (F.col("x") - F.col("start")) * (F.col("to_end") - F.col("to") - 1) / (F.col("end") - F.col("start") - 1)
    return inside.select(*by, F.bround(at, 0).cast("int").alias("x")).distinct()


def direct_copies(spans: DataFrame, output: DataFrame, source: DataFrame, by: list[str]) -> DataFrame:
    """by, copied: whether lineage proves that an output is an unchanged copy of its one source.

    spans: by.., start, end, operation, contributors, direct (one contributor, the source itself, neither scaled nor moved);
    output and source: by.., sample, value. Missing spans hold nothing, the others the source's very values, and at least one
    sample was observed.
    """
    each = spans.withColumn("sample", F.explode(F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1)).otherwise(F.array().cast("array<bigint>"))))
    pairs = each.join(output.select(*by, "sample", F.col("value").alias("_out")), [*by, "sample"], "left").join(source.select(*by, "sample", F.col("value").alias("_in")), [*by, "sample"], "left")
    missing = F.col("operation") == "missing"
    good = F.when(missing, F.col("_out").isNull()).otherwise((F.col("operation") == "selected_samples") & (F.col("contributors") == 1) & F.col("direct") & F.coalesce(F.col("_out") == F.col("_in"), F.lit(False)))
    return pairs.groupBy(*by).agg((F.min(good) & (F.count(F.when(~missing, 1)) > 0)).alias("copied"))
