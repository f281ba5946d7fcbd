"""Staged selection: filters that hold only where they leave something, then a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def staged(df: DataFrame, by: list[str], stages: list[Column]) -> DataFrame:
    """Rows that pass each stage in turn, where a stage that no row of a key passes is skipped for that key.

    Every stage is a window maximum over the same partitioning, so Spark sorts once.
    """
    w = Window.partitionBy(*by)
    for k, stage in enumerate(stages):
        flagged = df.withColumn(f"_s{k}", F.coalesce(stage, F.lit(False)))
        df = flagged.withColumn(f"_m{k}", F.max(f"_s{k}").over(w)).where(F.col(f"_s{k}") | ~F.col(f"_m{k}")).drop(f"_s{k}", f"_m{k}")
    return df


def top(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """First row of each key by a total order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def pooled(df: DataFrame, by: list[str], tiers: list[Column], order: list[Column]) -> DataFrame:
    """First row of the first tier that has any."""
    tier = F.lit(len(tiers))
    for k, rule in reversed(list(enumerate(tiers))):
        tier = F.when(F.coalesce(rule, F.lit(False)), k).otherwise(tier)
    return top(df.withColumn("tier", tier), by, [F.col("tier"), *order])


def largest_group(df: DataFrame, by: list[str], group: list[str], value: Column, cost: Column) -> DataFrame:
    """The group of each key with the most valuable member, then the least cost, then the most members, then its key."""
    g = df.groupBy(*by, *group).agg(F.max(value).alias("most"), F.coalesce(F.min(cost), F.lit(float("inf"))).alias("least"), F.count("*").alias("size"))
    return top(g, by, [F.desc("most"), F.col("least"), F.desc("size"), *(F.col(c) for c in group)])


def prioritised(sources: list[tuple[int, str, DataFrame]], by: list[str], order: list[str]) -> DataFrame:
    """Union of named sources; the first by priority, then `order`, then the source's place in the list."""
    every = None
    for k, (priority, name, df) in enumerate(sources):
        part = df.withColumn("priority", F.lit(priority)).withColumn("source", F.lit(name)).withColumn("_place", F.lit(k))
        every = part if every is None else every.unionByName(part, allowMissingColumns=True)
    return top(every, by, [F.col("priority"), *(F.col(c) for c in order), F.col("_place")]).drop("_place")


def first_source(df: DataFrame, by: list[str], sources: list[tuple[int, str, Column, Column]], order: list[str]) -> DataFrame:
    """`prioritised` for sources that are conditions on one table: (priority, name, condition, rank). One scan of df.

    Returns df's rows that win, with source and rank.
    """
    each = F.array(*(F.when(rule, F.struct(F.lit(p).alias("priority"), rank.alias("rank"), F.lit(k).alias("place"), F.lit(name).alias("source"))) for k, (p, name, rule, rank) in enumerate(sources)))
    dealt = df.withColumn("_each", F.explode(F.filter(each, lambda x: x.isNotNull()))).drop("rank")
    rows = dealt.select("*", F.col("_each.rank").alias("rank"), F.col("_each.source").alias("source"))
    return top(rows, by, [F.col("_each.priority"), F.col("rank"), *(F.col(c) for c in order), F.col("_each.place")]).drop("_each")


def first_match(df: DataFrame, levels: list[tuple[str, DataFrame, list[str]]], value: str) -> DataFrame:
    """df with `value` and `level` of the first lookup that has it: a chain of left joins and coalesce."""
    found, names = [], []
    for k, (name, dim, keys) in enumerate(levels):
        df = df.join(dim.select(*keys, F.col(value).alias(f"_v{k}")), keys, "left")
        found.append(F.col(f"_v{k}"))
        names.append(F.when(F.col(f"_v{k}").isNotNull(), name))
    return df.withColumn(value, F.coalesce(*found)).withColumn("level", F.coalesce(*names)).drop(*(f"_v{k}" for k in range(len(levels))))


def fused(samples: DataFrame, chosen: DataFrame, by: list[str], ident: str) -> DataFrame:
    """Samples of the candidate chosen for each key."""
    return samples.join(chosen.select(*by, ident), [*by, ident])


def deduplicated(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by an order."""
    return top(df, by, order)


def repaired(df: DataFrame, peers: DataFrame, gaps: DataFrame, by: list[str], most: int, limit: float) -> DataFrame:
    """by, sample, value filled in gaps of at most `most` samples: the median of peers that have the whole gap and lie
    within the limit of the series at both edges; at least two peers, whose spread is within the limit at every sample.
    All of a gap is filled or nothing.
    """
    short = gaps.where(F.col("length") <= most)
    edges = short.join(df.select(*by, F.col("sample").alias("s0"), F.col("value").alias("left")), by).where("s0 = start - 1").join(df.select(*by, F.col("sample").alias("s1"), F.col("value").alias("right")), by).where("s1 = end")
    inside = short.select(*by, "start", "end", "length", F.explode(F.sequence(F.col("start") - 1, F.col("end"))).alias("sample")).join(peers.select(*by, "peer", "sample", "value"), [*by, "sample"])
    near = inside.join(edges.select(*by, "start", "left", "right"), [*by, "start"])
    ok = near.groupBy(*by, "start", "end", "length", "peer").agg(F.count("value").alias("n"), F.max(F.when(F.col("sample") == F.col("start") - 1, F.abs(F.col("value") - F.col("left")))).alias("d0"), F.max(F.when(F.col("sample") == F.col("end"), F.abs(F.col("value") - F.col("right")))).alias("d1")).where((F.col("n") == F.col("length") + 2) & (F.col("d0") <= limit) & (F.col("d1") <= limit)).select(*by, "start", "peer")
    kept = inside.join(ok, [*by, "start", "peer"]).where((F.col("sample") >= F.col("start")) & (F.col("sample") < F.col("end")))
    filled = kept.groupBy(*by, "start", "sample").agg(F.count("*").alias("n"), (F.max("value") - F.min("value")).alias("spread"), F.expr("percentile(value, 0.5)").alias("value"))
    good = filled.groupBy(*by, "start").agg(F.every((F.col("n") >= 2) & (F.col("spread") <= limit)).alias("ok")).where("ok")
    return filled.join(good, [*by, "start"]).select(*by, "start", "sample", "value")
