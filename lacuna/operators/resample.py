"""Resampling and alignment that never bridges a gap."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lacuna.plans import policy

from .islands import spans


def affine_sample(df: DataFrame, by: list[str], hypotheses: DataFrame, center: Column, n: Column) -> DataFrame:
    """by, hypothesis columns, sample, value at center + (sample - center) * scale + shift, linear between neighbours.

    Null where the upper neighbour is missing; samples whose lower neighbour is missing or that fall outside don't appear. df has
    by, sample (each once), value; center and n are literals or made of by. A series becomes one row with its samples in order,
    so only the series itself is shuffled, and all of its hypotheses are tried where it lies. The hypotheses are few.
    """
    fields, tried = df.schema, hypotheses.collect()
    kinds = StructType([*(fields[b] for b in by), *hypotheses.schema, fields["sample"], StructField("value", DoubleType())])
    listed = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("sample", F.col("value").cast("double").alias("value")))).alias("_l"))
    held = listed.select(*by, F.col("_l.sample").alias("_s"), F.col("_l.value").alias("_v"), center.cast("double").alias("_c"), n.cast("double").alias("_n"))
    scales, shifts = (np.array([h[k] for h in tried], dtype=float)[:, None] for k in ("scale", "shift"))
    step = 1 << 20  # rows made at once
    schema = to_arrow_schema(kinds)
    names = hypotheses.columns

    def made(row: pa.RecordBatch, i: int) -> Iterator[pa.RecordBatch]:
        samples, values = (row.column(k)[i].values.to_numpy(zero_copy_only=False) for k in ("_s", "_v"))
        values, c, last = values.astype(float), row.column("_c")[i].as_py(), row.column("_n")[i].as_py()
        empty = row.column("_v")[i].values.is_null().to_numpy(zero_copy_only=False)
        few = max(1, step // len(samples))
        for lo in range(0, len(scales), few):
            at = c + (samples[None, :] - c) * scales[lo : lo + few] + shifts[lo : lo + few]
            low = np.floor(at)
            k = np.searchsorted(samples, low).clip(0, len(samples) - 1)
            h, j = np.nonzero((samples[k] == low) & (at <= last - 1))
            k, part, above = k[h, j], (at - low)[h, j], np.minimum(k[h, j] + 1, len(samples) - 1)
            bare = empty[k] | (part != 0) & ((samples[above] != samples[k] + 1) | empty[above])
            value = np.where(part == 0, values[k], values[k] + (values[above] - values[k]) * np.where(part == 0, 0, part))
            keys = [pa.repeat(row.column(b)[i], len(h)) for b in by]
            trial = [pa.array([t[name] for t in tried[lo : lo + few]], schema.field(name).type).take(pa.array(h)) for name in names]
            yield pa.RecordBatch.from_arrays([*keys, *trial, pa.array(samples[j], schema.field("sample").type), pa.array(value, mask=bare)], schema=schema)

    def tries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from made(batch, i)

    return held.mapInArrow(tries, kinds)


def hypothesis_table(spark, radius: int = policy.ALIGN_RADIUS, scales: list[float] | None = None) -> DataFrame:
    """hyp (order of trial), scale, shift; its size is fixed by the policy."""
    rows = [(i * (2 * radius + 1) + s + radius, x, s) for i, x in enumerate(scales or policy.ALIGN_SCALES) for s in range(-radius, radius + 1)]
    return spark.createDataFrame(rows, "hyp int, scale double, shift int")


def alignment_metrics(pairs: DataFrame, by: list[str], expected: Column) -> DataFrame:
    """by, overlap, offset (median of b - a), rmse of the smallest 99 % of absolute residuals; pairs has a, b, n."""
    need = F.least(F.col("n"), F.greatest(F.lit(policy.MIN_SAMPLES), F.ceil(F.col("n") * F.lit(policy.MIN_OVERLAP))))
    both = pairs.where("a is not null and b is not null")
    mid = both.groupBy(*by).agg(F.count("*").alias("overlap"), F.expr("percentile(b - a, 0.5)").alias("offset"), F.max(expected).alias("n")).where(F.col("overlap") >= need).drop("n")
    res = both.join(mid, by).withColumn("r", F.abs(F.col("b") - F.col("a") - F.col("offset")))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("r"))
    kept = res.withColumn("k", rank).where(F.col("k") <= F.ceil(F.col("overlap") * F.lit(policy.TRIM_KEEP)))
    return kept.groupBy(*by).agg(F.first("overlap").alias("overlap"), F.first("offset").alias("offset"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rmse"))


def resample_runs(df: DataFrame, by: list[str], ratio: float) -> DataFrame:
    """by, target, value: linear resampling inside runs of consecutive samples at positions target / ratio.

    A single sample goes to the nearest target; nothing is made between runs.
    """
    runs = spans(df.where("value is not null"), by, []).select(*by, "start", "end")
    w = Window.partitionBy(*by).orderBy("sample")
    points = df.where("value is not null").select(*by, F.col("sample").alias("lo"), F.col("value").alias("v0"), F.lead("value").over(w).alias("v1"))
    single = (F.col("end") - F.col("start")) == 1
    first, last = F.ceil(F.col("start") * F.lit(ratio)), F.floor((F.col("end") - 1) * F.lit(ratio))
    targets = runs.select(*by, "start", "end", F.explode(F.when(single, F.array(F.floor(F.col("start") * F.lit(ratio) + 0.5))).when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("target"))
    at = F.when(single, F.col("start").cast("double")).otherwise(F.col("target") / F.lit(ratio))
    placed = targets.withColumn("at", at).withColumn("lo", F.least(F.floor("at"), F.col("end") - 1))
    part = F.col("at") - F.col("lo")
    return placed.join(points, [*by, "lo"]).select(*by, "target", F.when(part == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * part).alias("value"))


def nearest(df: DataFrame, others: DataFrame, by: list[str], at: str = "sample") -> DataFrame:
    """df with `near`: the place of the nearest row of others of the same key (the earlier one of two); null if none.

    Union and two running windows: no pair of rows is ever joined.
    """
    mine = df.select("*", F.lit(1).alias("_mine"))
    both = mine.unionByName(others.select(*by, at).distinct().withColumn("_mine", F.lit(0)), allowMissingColumns=True)
    other = F.when(F.col("_mine") == 0, F.col(at))
    w = Window.partitionBy(*by).orderBy(at)
    before = F.last(other, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first(other, ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumn("_p", before).withColumn("_f", after).where("_mine = 1")
    return placed.withColumn("near", F.when(F.col("_f").isNull() | (F.col(at) - F.col("_p") <= F.col("_f") - F.col(at)), F.col("_p")).otherwise(F.col("_f"))).drop("_mine", "_p", "_f")
