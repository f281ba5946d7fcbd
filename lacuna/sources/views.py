"""Signal, candidate, artifact, review and run views on the tables of a data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df in parts of about so many rows, by keys: a small file is read by few tasks, whatever its rows become behind."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), *keys)


def regular_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, grp, sample, value: one row per element of an embedding."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("series"), F.col("label").alias("grp"), F.posexplode("embedding").alias("sample", "v")).select("series", "grp", "sample", F.col("v").cast("double").alias("value"))


def _epoch() -> F.Column:
    return F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)


def gapped_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, sample (six-hour slot), value: average of a user's events; slots without events are missing."""
    e = read(spark, sf_dir, "events").select("user_id", F.floor(_epoch() / 21600).cast("long").alias("sample"), "value")
    return e.groupBy(F.col("user_id").alias("series"), "sample").agg(F.round(F.avg("value"), 6).alias("value"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, sample (day), candidate (event type), value: competing extractions of a sample."""
    e = read(spark, sf_dir, "events").select("user_id", F.floor(_epoch() / 86400).cast("long").alias("sample"), F.col("event_type").alias("candidate"), "value")
    return e.groupBy(F.col("user_id").alias("series"), "sample", "candidate").agg(F.round(F.avg("value"), 6).alias("value"))


def pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking pools: an order's lines as candidates with penalties and flags."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("candidate"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("layout"),
        F.col("l_quantity").alias("score"), F.round(F.col("l_discount") * 100).cast("int").alias("warnings"), F.round(F.col("l_tax") * 100).cast("int").alias("missing"), (F.col("l_suppkey") % 7).cast("int").alias("crop"),
    )
