"""Staged intake of runs with heartbeats: what becomes of an intake that nobody finishes.

events: run, ts, kind (staged, committed, heartbeat, archived), valid (whether the source is what its journal says). An intake
lasts while its events follow each other within `grace`. It ends when it is archived, or when the grace has passed since its
last event: it is then recovered if it has a journal (it was staged or committed) whose latest source was valid, else failed.
An intake of heartbeats alone has no journal. What comes after an end is a new intake.

`outcomes` says it of a whole log, `recoveries` of a stream: state and a timer for each run, in event time, so a restart from
the checkpoint goes on where it was. Both give the same rows for the same log, but for intakes that are still open at its end
(deferred), which a stream hasn't ended yet. Events of one time are taken in the order staged, committed, heartbeat, archived;
a null kind is a heartbeat, a null valid isn't valid, events without a time or a run are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

KINDS = ["staged", "committed", "heartbeat", "archived"]
OUTPUT = "run long, opened timestamp, last timestamp, events long, outcome string"
STATE = "opened long, last long, events long, journal boolean, valid boolean"


def _ordered(events: DataFrame) -> DataFrame:
    kind = F.when(F.col("kind").isin(KINDS), F.col("kind")).otherwise("heartbeat")
    known = events.where("run is not null and ts is not null").select(F.col("run").cast("long").alias("run"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("kind"), F.coalesce("valid", F.lit(False)).alias("valid"))
    return known.withColumn("place", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")))


def outcomes(events: DataFrame, grace: str) -> DataFrame:
    """run, opened, last, events, outcome (archived, recovered, failed or deferred) of every intake of a log; the log's end is
    its last event's time."""
    held, span = _ordered(events), F.expr(f"interval {grace}")
    own = Window.partitionBy("run").orderBy("ts", "place", "valid")
    starts = F.lag("ts").over(own).isNull() | (F.col("ts") >= F.lag("ts").over(own) + span) | (F.lag("kind").over(own) == "archived")
    numbered = held.withColumn("starts", starts).withColumn("intake", F.sum(F.col("starts").cast("int")).over(own))
    journal = F.max_by(F.when(F.col("kind").isin("staged", "committed"), F.col("valid")), F.when(F.col("kind").isin("staged", "committed"), F.struct("ts", "place", "valid")))
    grouped = numbered.groupBy("run", "intake").agg(F.min("ts").alias("opened"), F.max("ts").alias("last"), F.count("*").alias("events"), F.max(F.col("kind") == "archived").alias("archived"), journal.alias("valid"))
    end = held.agg(F.max("ts").alias("end"))
    outcome = F.when(F.col("archived"), "archived").when(F.col("end") < F.col("last") + span, "deferred").when(F.coalesce("valid", F.lit(False)), "recovered").otherwise("failed")
    return grouped.crossJoin(F.broadcast(end)).select("run", "opened", "last", "events", outcome.alias("outcome"))  # one row


class Recovery(StatefulProcessor):
    """The open intake of a run, and a timer that ends it."""

    def __init__(self, grace_ms: int) -> None:
        self.grace = grace_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.open = handle, handle.getValueState("intake", STATE)

    def _row(self, run: int, state: tuple, outcome: str) -> tuple:
        return run, state[0], state[1], state[2], outcome

    def _ended(self, state: tuple) -> str:
        return "recovered" if state[3] and state[4] else "failed"

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["run", "opened", "last", "events", "outcome"])
        return out.assign(**{n: pd.to_datetime(out[n], unit="us") for n in ("opened", "last")})

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["us", "place", "valid"])
        state, out = (self.open.get() if self.open.exists() else None), []
        for us, kind, valid in zip(pdf["us"].tolist(), pdf["kind"], pdf["valid"].tolist(), strict=True):
            if state is not None and us >= state[1] + self.grace * 1000:
                out.append(self._row(key[0], state, self._ended(state)))
                state = None
            opened, last, n, journal, sound = state or (us, us, 0, False, False)
            if kind in ("staged", "committed"):
                journal, sound = True, bool(valid)
            state = (min(opened, us), max(last, us), n + 1, journal, sound)
            if kind == "archived":
                out.append(self._row(key[0], state, "archived"))
                state = None
        if state is None:
            self.open.clear()
            self._timer(None)
        else:
            self.open.update(state)
            self._timer(state[1] // 1000 + self.grace)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            state = self.open.get()
            out.append(self._row(key[0], state, self._ended(state)))
            self.open.clear()
        yield self._frame(out)

    def close(self) -> None:
        pass


def recoveries(events: DataFrame, grace: str, delay: str = "0 seconds") -> DataFrame:
    """The ends of intakes of a stream, each when it is known; append mode. Needs the RocksDB state store."""
    ms = int(pd.Timedelta(grace).total_seconds() * 1000)
    held = _ordered(events).withWatermark("ts", delay).withColumn("us", F.unix_micros("ts"))
    return held.groupBy("run").transformWithStateInPandas(Recovery(ms), OUTPUT, "Append", "EventTime")
