"""Streaming twins of the append-only logs: latest review, heartbeats and leases, intake of new files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_reviews(events: DataFrame) -> DataFrame:
    """run, seq, decision, event_count: update mode; events: run, seq, decision. The maximum is over (seq, decision), so the
    result doesn't depend on the order of arrival."""
    last = F.max(F.struct("seq", "decision"))
    return events.groupBy("run").agg(last.alias("last"), F.count("*").alias("event_count")).select("run", "last.seq", "last.decision", "event_count")


def windowed_quality(events: DataFrame, delay: str = "1 hour", width: str = "6 hours") -> DataFrame:
    """series, window start, count, average and largest value of an event-time window; late rows beyond the delay go."""
    w = events.withWatermark("ts", delay).groupBy("series", F.window("ts", width).alias("w"))
    return w.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("top")).select("series", F.col("w.start").alias("start"), "n", "mean", "top")


def leases(claims: DataFrame, stale_s: float) -> DataFrame:
    """run, owner, granted: a claim is granted if the run is free, its own or stale; claims: run, owner, ts (seconds, double).

    State of a run is its owner and last heartbeat; it expires after the stale time of processing.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        owner, since = state.get if state.exists else (None, float("-inf"))
        rows = pd.concat(list(batches)).sort_values(["ts", "owner"])
        out = []
        for who, ts in zip(rows["owner"], rows["ts"], strict=True):
            ok = owner is None or who == owner or ts - since >= stale_s
            if ok:
                owner, since = who, ts
            out.append((key[0], who, ts, ok))
        state.update((owner, since))
        state.setTimeoutDuration(max(1, int(stale_s * 1000)))
        yield pd.DataFrame(out, columns=["run", "owner", "ts", "granted"])

    return claims.groupBy("run").applyInPandasWithState(step, "run long, owner string, ts double, granted boolean", "owner string, since double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def intake(files: DataFrame, out: str, checkpoint: str, admit: Callable[[DataFrame], DataFrame]):
    """Writes what `admit` lets through, each batch under its own number: a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        admit(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
