"""Canonical signal files: wide CSV with a column per channel, blank cells missing, and its long form."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parse_cell(cell: Column) -> Column:
    """A number, or null where the cell is blank, no number or not finite."""
    value = F.trim(cell).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == F.lit(float("inf"))), None).otherwise(value)


def read_wide(spark: SparkSession, path: str, channels: list[str]) -> DataFrame:
    """file, sample (row of the file), and a nullable double per channel.

    A CSV row has no index. The row's place within its file comes from the reader's block start and an increasing id, so
    that files are numbered side by side without a global sort.
    """
    text = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in channels))
    numbered = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), *(parse_cell(F.col(f"`{c}`")).alias(c) for c in channels))
    return numbered.select("file", (F.row_number().over(Window.partitionBy("file").orderBy("block", "at")) - 1).alias("sample"), *(F.col(f"`{c}`") for c in channels))


def to_long(wide: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """keys, channel, value."""
    return wide.unpivot(keys, channels, "channel", "value")


def to_wide(long: DataFrame, channels: list[str], keys: list[str]) -> DataFrame:
    """A column per channel; channels are given, so that no job looks for them."""
    return long.groupBy(*keys).pivot("channel", channels).agg(F.first("value", ignorenulls=True))


def write_wide(wide: DataFrame, path: str, channels: list[str], n_samples: int, decimals: int = 8, keys: tuple[str, ...] = ()) -> None:
    """CSV of a dense frame of n_samples rows for each key; missing cells are empty."""
    spark = wide.sparkSession
    frame = spark.range(n_samples).select(F.col("id").alias("sample"))
    if keys:
        frame = wide.select(*keys).distinct().crossJoin(F.broadcast(frame)) if n_samples <= 100_000 else wide.select(*keys).distinct().select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample"))
    dense = frame.join(wide, [*keys, "sample"], "left").select(*keys, "sample", *(F.round(F.col(f"`{c}`"), decimals).alias(c) for c in channels))
    dense.repartitionByRange(*keys, "sample").sortWithinPartitions(*keys, "sample").drop("sample").write.csv(path, header=True, emptyValue="", nullValue="")


#: The columns of an uncertainty table, in the order of its file.
UNCERTAINTY = "lead string, lead_sample int, t_s_at_500hz double, canonical_sample int, value_uv double, review_estimate_uv double, status string, annotation_overlap int, candidate_count int, candidate_spread_uv double"


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name below spark.checkpoint.dir, or the context's checkpoint folder; below a temporary folder only for a
    session of one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = own.get() if own.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.gettempdir()}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def write_uncertainty(rows: DataFrame, path: str | None = None) -> str:
    """Write an uncertainty table as CSV, a lead's samples together and in order; missing numbers are empty. Returns the path."""
    path = path or scratch(rows.sparkSession, "uncertainty")
    names = [c.split()[0] for c in UNCERTAINTY.split(", ")]
    rows.select(names).repartitionByRange("lead", "lead_sample").sortWithinPartitions("lead", "lead_sample").write.csv(path, header=True, emptyValue="", nullValue="")
    return path


def read_uncertainty(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=UNCERTAINTY)


def write_records(rows: DataFrame, key: str, path: str) -> None:
    """Metadata or provenance records as JSON lines, one for each row, with the fields in alphabetical order; a folder for each `key` prefix keeps listings small."""
    fields = sorted(rows.columns)
    held = rows.select(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 2).alias("shard"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))
    held.write.partitionBy("shard").text(path)


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records as columns; a line that is no such record is left out here and counted by `broken_records`."""
    return _parsed(spark, path, schema).where("record is not null").select("record.*")


def broken_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return _parsed(spark, path, schema).where("record is null").select("value")


def _parsed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    found = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select("value", found.alias("record")).withColumn("record", F.when(F.col("record._bad").isNull(), F.col("record").dropFields("_bad")))
