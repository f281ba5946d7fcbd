"""Bundles are complete or absent, and come back as they were written; intakes end alike in a log and in a stream."""

import math
import os
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lacuna.sources import bundles, signals
from lacuna.streaming import intakes

SCHEMA = "k long, v double, f float, t string, b boolean"
ROWS = [(1, 0.1, 1.5, 'say "x", y', True), (2, -0.0, None, "", False), (3, float("nan"), float("inf"), None, None), (None, 1e-310, -2.25, "two\nlines\r\n é 日本", True), (5, 1.7976931348623157e308, 0.0, "null", False), (6, None, 3.0, " ", None)]


def alike(a, b):
    return all(x == y or (isinstance(x, float) and isinstance(y, float) and math.isnan(x) and math.isnan(y)) for x, y in zip(a, b, strict=True))


def test_values_come_back(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/one"
    bundles.write_bundle(spark.createDataFrame(ROWS, SCHEMA).repartition(3, "k"), path)
    back = bundles.read_bundle(spark, path)
    assert back.schema.simpleString() == "struct<k:bigint,v:double,f:float,t:string,b:boolean>"
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted((tuple(r) for r in back.collect()), key=key)
    assert len(got) == len(ROWS) and all(alike(a, b) for a, b in zip(got, sorted(ROWS, key=key), strict=True))
    assert math.copysign(1, next(r for r in got if r[0] == 2)[1]) == -1
    files = bundles.manifest(spark, path).collect()
    assert sum(f["rows"] for f in files) == len(ROWS) and all(os.path.getsize(f"{path}/{f['name']}") == f["bytes"] for f in files)
    assert sorted(os.listdir(path)) == sorted([f["name"] for f in files] + ["manifest.json", "_COMPLETE"])
    with pytest.raises(FileExistsError):
        bundles.write_bundle(back, path)


def test_a_failing_task_leaves_no_bundle(spark, tmp_path):
    path = f"{tmp_path}/none"
    bad = spark.range(0, 60, 1, 6).select("id", F.when(F.col("id") == 59, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="no"):
        bundles.write_bundle(bad, path)
    assert not os.path.exists(f"{path}/_COMPLETE") and not os.path.exists(f"{path}/_staged") and not os.path.exists(f"{path}/manifest.json")
    with pytest.raises(Exception, match="no complete bundle"):
        bundles.read_bundle(spark, path).count()
    bundles.write_bundle(spark.range(5), path)  # the place is free
    assert bundles.read_bundle(spark, path).count() == 5


def test_changes_are_found(spark, tmp_path):
    path = f"{tmp_path}/changed"
    bundles.write_bundle(spark.range(0, 40, 1, 2), path)
    back = bundles.read_bundle(spark, path)
    with open(f"{path}/part-000001.csv", "ab") as f:
        f.write(b"99\n")
    with pytest.raises(Exception, match="manifest says"):
        back.count()
    with open(f"{path}/manifest.json", "ab") as f:
        f.write(b" ")
    with pytest.raises(Exception, match="has changed"):
        bundles.read_bundle(spark, path).count()


def test_edges(spark, tmp_path):
    empty = f"{tmp_path}/empty"
    bundles.write_bundle(spark.range(0), empty)
    assert bundles.read_bundle(spark, empty).count() == 0 and bundles.manifest(spark, empty).count() == 0
    with pytest.raises(Exception, match="can't hold"):
        bundles.write_bundle(spark.range(3).select(F.array("id").alias("a")), f"{tmp_path}/nested")
    many = f"{tmp_path}/many"
    bundles.write_bundle(spark.range(0, 450_000, 1, 1), many)
    listed = bundles.manifest(spark, many).orderBy("name").collect()
    assert [r["rows"] for r in listed] == [200_000, 200_000, 50_000] and bundles.read_bundle(spark, many).agg(F.sum("id")).first()[0] == 449_999 * 225_000
    rows = [((1, "x"), (None, ""))]
    for row in rows:
        assert list(bundles.decode(bundles.encode(list(row), ["k", "t"]), spark.createDataFrame([], "k long, t string").schema)) == list(row)


def test_scratch_follows_the_session_and_its_context():
    def session(setting, context, master):
        held = SimpleNamespace(isDefined=lambda: context is not None, get=lambda: context)
        jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: held))
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: setting), sparkContext=SimpleNamespace(_jsc=jsc, master=master))

    assert signals.scratch(session("hdfs://x/shared/", "other", "yarn"), "a").startswith("hdfs://x/shared/a-")
    assert signals.scratch(session(None, "hdfs://y", "yarn"), "a").startswith("hdfs://y/a-")
    assert signals.scratch(session(None, None, "local[2]"), "a").startswith("file://")
    with pytest.raises(ValueError):
        signals.scratch(session(None, None, "yarn"), "a")


def log(seed, n=300):
    rng, start, rows = random.Random(seed), datetime(2024, 3, 1), []
    t = {}
    for _ in range(n):
        run = rng.randrange(6)
        t[run] = t.get(run, start) + timedelta(minutes=rng.choice([1, 5, 20, 40, 59, 60, 90]))
        rows.append((run, t[run], rng.choice(["staged", "committed", "heartbeat", "heartbeat", "heartbeat", "archived", None]), rng.choice([True, False, None])))
    return sorted(rows, key=lambda r: r[1]) + [(99, max(t.values()) + timedelta(days=2), "heartbeat", True)]


def plain_outcomes(rows, grace):
    out, end = [], max(r[1] for r in rows)
    order = {"staged": 0, "committed": 1, "heartbeat": 2, "archived": 3}
    for run in {r[0] for r in rows}:
        now = None
        for _, ts, kind, valid in sorted((r for r in rows if r[0] == run), key=lambda r: (r[1], order[r[2] or "heartbeat"], r[3] or False)):
            if now and ts - now[1] >= grace:
                out.append((run, *now[:3], "recovered" if now[3] else "failed"))
                now = None
            now = now or [ts, ts, 0, False]
            now[1], now[2] = ts, now[2] + 1
            if kind in ("staged", "committed"):
                now[3] = bool(valid)
            if kind == "archived":
                out.append((run, *now[:3], "archived"))
                now = None
        if now:
            out.append((run, *now[:3], "deferred" if end - now[1] < grace else "recovered" if now[3] else "failed"))
    return sorted(out)


SCHEMA_OF_LOG = "run long, ts timestamp, kind string, valid boolean"


def test_outcomes_of_a_log(spark):
    rows = log(1)
    got = sorted(tuple(r) for r in intakes.outcomes(spark.createDataFrame(rows + [(None, rows[0][1], "staged", True), (1, None, "staged", True)], SCHEMA_OF_LOG), "1 hour").collect())
    assert got == plain_outcomes(rows, timedelta(hours=1)) and {r[4] for r in got} == {"archived", "recovered", "failed", "deferred"}
    assert intakes.outcomes(spark.createDataFrame([], SCHEMA_OF_LOG), "1 hour").count() == 0


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Each part of the log is a stream of its own, started from the checkpoint of the one before."""
    rows = log(2, 160)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, part in enumerate((rows[:50], rows[50:110], rows[110:-1], rows[-1:])):
            spark.createDataFrame(part, SCHEMA_OF_LOG).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
            found = intakes.recoveries(spark.readStream.schema(SCHEMA_OF_LOG).parquet(f"{tmp_path}/log"), "1 hour")
            q = found.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            assert q.awaitTermination(120), k
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [r for r in plain_outcomes(rows, timedelta(hours=1)) if r[4] != "deferred"]
