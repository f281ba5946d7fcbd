"""Panels of a page: slices of a series by layout, and what is blanked in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans import policy


def panel_bounds(n: Column, columns: Column, column: Column, full: Column) -> tuple[Column, Column]:
    """Start and end of a panel: equal parts, the last one takes the remainder; a full-width series has all."""
    part = F.floor(n / columns)
    start = F.when(full, F.lit(0)).otherwise(column * part)
    end = F.when(full | (column == columns - 1), n).otherwise((column + 1) * part)
    return start.cast("int"), end.cast("int")


def sliced(df: DataFrame) -> DataFrame:
    """Rows inside [start, end) with local_sample."""
    return df.where("sample >= start and sample < end").withColumn("local_sample", (F.col("sample") - F.col("start")).cast("int"))


def sanitized(df: DataFrame) -> DataFrame:
    """Values outside the panel are blanked."""
    return df.withColumn("value", F.when((F.col("sample") >= F.col("start")) & (F.col("sample") < F.col("end")), F.col("value")))


def without_near_flat(df: DataFrame, by: list[str], limit: float = policy.NEAR_FLAT, least: int = policy.MIN_SAMPLES) -> DataFrame:
    """A series of `least` values or more whose nearest-rank P99 - P01 is below `limit` is blanked as a whole."""
    spread = df.groupBy(*by).agg(F.count("value").alias("_n"), (F.expr("percentile_disc(0.99) within group (order by value)") - F.expr("percentile_disc(0.01) within group (order by value)")).alias("_spread"))
    flat = (F.col("_n") >= least) & (F.col("_spread") < limit)
    return df.join(spread, by).withColumn("flat", flat).withColumn("value", F.when(~flat, F.col("value"))).drop("_n", "_spread")


def without_boundaries(df: DataFrame, n: Column, local: Column, first: float = policy.START_MASK, last: float = policy.END_MASK) -> DataFrame:
    """Blanks the first and last share of a panel of n samples."""
    outside = (local < F.ceil(n * F.lit(first))) | (local >= n - F.ceil(n * F.lit(last)))
    return df.withColumn("value", F.when(~outside, F.col("value")))


def mapped_boxes(boxes: DataFrame, rows: DataFrame, width: int, columns: int, margin: int) -> DataFrame:
    """Boxes (box, x0, x1, cy) as sample intervals of the nearest row: box, row, col, start, end."""
    cx = (F.col("x0") + F.col("x1")) / 2.0
    centers = rows.agg(F.collect_list(F.struct("center", "row")).alias("_rows"))  # the rows of one page
    near = F.array_min(F.transform("_rows", lambda r: F.struct(F.abs(F.col("cy") - r["center"]).alias("far"), r["row"].alias("row"))))
    placed = boxes.crossJoin(F.broadcast(centers)).withColumn("row", near["row"]).where("row is not null")
    return placed.select("box", "row", F.least(F.lit(columns - 1), F.floor(cx / width * columns)).cast("int").alias("col"), F.greatest(F.lit(0), F.col("x0") - margin).alias("start"), F.least(F.lit(width), F.col("x1") + margin).alias("end"))


def compact(df: DataFrame, channels: list[str], rate: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Wide table of panels re-based to local samples: by, local_sample, t, a column per channel."""
    return df.groupBy(*by, "local_sample").pivot("channel", channels).agg(F.first("value", ignorenulls=True)).withColumn("t", F.col("local_sample") / F.lit(rate))


def affine_correction(df: DataFrame, by: list[str], n: Column) -> DataFrame:
    """Per key the stretch of reference series: scale where two or more span 90 % at 90 % density within 5 % of each other."""
    per = df.where("value is not null").groupBy(*by, "series").agg(F.min("sample").alias("a"), F.max("sample").alias("b"), F.count("value").alias("c"), F.first(n).alias("n"))
    good = per.where((F.col("b") - F.col("a") + 1 >= 0.9 * F.col("n")) & (F.col("c") >= 0.9 * (F.col("b") - F.col("a") + 1)))
    rows = good.groupBy(*by).agg(F.count("*").alias("refs"), F.expr("percentile(a, 0.5)").alias("a"), F.expr("percentile(b, 0.5)").alias("b"), (F.max("a") - F.min("a")).alias("da"), (F.max("b") - F.min("b")).alias("db"), F.first("n").alias("n"))
    scale = (F.col("n") - 1) / (F.col("b") - F.col("a"))
    return rows.select(*by, "refs", F.when((F.col("refs") >= 2) & scale.between(1.005, 1.2) & (F.col("da") <= 0.05 * F.col("n")) & (F.col("db") <= 0.05 * F.col("n")), scale).alias("scale"))

