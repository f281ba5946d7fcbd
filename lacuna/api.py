"""Session-level use: a store of runs on a shared folder, with append-only tables of runs, signals and reviews.

    store = Store(spark, "hdfs:///signals")
    store.add(runs, signals)              # many runs at once
    store.get(ids)                        # the runs with their status after reviews
    store.evidence(ids)                   # quality of every series of these runs
    store.review(decisions)               # accepted only where the contract lets it be

Every call takes and returns DataFrames, so one run and a million runs are the same plan. Tables are partitioned by a hash of
the run, and a lookup of few runs reads their partitions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import contracts
from lacuna.operators import evidence, quality

SHARDS = 256
RUNS = "run string, created_at timestamp, status string, outcome string, assets array<string>, retention_version int"
SIGNALS = "run string, series string, sample bigint, value double"
REVIEWS = "run string, created_at timestamp, decision string, reviewer string, notes string, confirmations map<string,boolean>"


class Store:
    def __init__(self, spark: SparkSession, root: str, shards: int = SHARDS) -> None:
        self.spark, self.root, self.shards = spark, root.rstrip("/"), shards

    def _shard(self, run: Column) -> Column:
        return F.pmod(F.xxhash64(run), F.lit(self.shards)).cast("int")

    def _append(self, rows: DataFrame, name: str, schema: str) -> None:
        columns = [c.strip().split()[0] for c in schema.replace("map<string,boolean>", "map").split(", ")]
        rows.select(*columns, self._shard(F.col("run")).alias("shard")).repartition("shard").write.mode("append").partitionBy("shard").parquet(f"{self.root}/{name}")

    def _table(self, name: str, schema: str, runs: DataFrame | None = None) -> DataFrame:
        """A table, empty before its first row; of few runs (a checked number) only their partitions."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], schema)
        table = self.spark.read.schema(f"{schema}, shard int").parquet(f"{self.root}/{name}")
        if runs is not None:
            wanted = runs.select(F.col("run").cast("string").alias("run"), self._shard(F.col("run").cast("string")).alias("shard")).distinct()
            shards = [r["shard"] for r in wanted.select("shard").distinct().limit(self.shards + 1).collect()]  # at most `shards` numbers
            table = table.where(F.col("shard").isin(shards)).join(wanted.select("run"), "run", "left_semi")
        return table.drop("shard")

    def add(self, runs: DataFrame, signals: DataFrame) -> DataFrame:
        """Append runs that keep the contract and their signals; returns the violations (run, rule) of the others."""
        rules = {"invalid_id": F.length("run") > 0, "invalid_status": F.col("status").isin(contracts.STATUSES), "invalid_assets": F.col("assets").isNotNull(), "invalid_time": F.col("created_at").isNotNull()}
        kept = reduce(lambda a, b: a & F.coalesce(b, F.lit(False)), rules.values(), F.lit(True))
        good = runs.where(kept)
        self._append(good, "runs", RUNS)
        self._append(signals.join(good.select("run"), "run", "left_semi"), "signals", SIGNALS)
        return evidence.violations(runs, ["run"], rules)

    def get(self, runs: DataFrame | None = None) -> DataFrame:
        """The runs (all without an argument), newest first within a partition, with `review` and the status after it."""
        held = self._table("runs", RUNS, runs)
        last = evidence.latest(self._table("reviews", REVIEWS, runs), ["run"], [F.desc("created_at"), F.desc("decision")]).select("run", F.col("decision").alias("review"))
        return held.join(last, "run", "left").withColumn("status", F.coalesce(evidence.review_status(F.col("review"), F.col("status")), F.col("status")))

    def evidence(self, runs: DataFrame | None = None) -> DataFrame:
        """run, series and the quality of each series."""
        signals = self._table("signals", SIGNALS, runs).where("value is not null")
        return quality.series_quality(signals, ["run", "series"])

    def review(self, decisions: DataFrame) -> DataFrame:
        """Append decisions (run, created_at, decision, reviewer, notes, confirmations); returns those refused, with `reason`.

        A rejection always counts. An acceptance needs all confirmations and a run whose numbers can be accepted.
        """
        runs = self._table("runs", RUNS, decisions).select("run", contracts.acceptable(F.col("outcome"), F.col("assets"), F.col("retention_version")).alias("able"))
        judged = decisions.join(runs, "run", "left")
        reason = F.when(F.col("able").isNull(), "unknown_run").when(~F.coalesce(F.col("decision").isin("accepted", "rejected"), F.lit(False)), "unknown_decision").when((F.col("decision") == "accepted") & ~F.coalesce(contracts.confirmed(F.col("confirmations")), F.lit(False)), "unconfirmed").when((F.col("decision") == "accepted") & ~F.col("able"), "not_acceptable")
        judged = judged.withColumn("reason", reason)
        self._append(judged.where("reason is null"), "reviews", REVIEWS)
        return judged.where("reason is not null").drop("able")
