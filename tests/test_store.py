"""The store of runs, its reviews, and record files."""

from datetime import datetime

from pyspark.sql import functions as F

from lacuna.api import RUNS, SIGNALS, Store
from lacuna.sources import signals

T = datetime(2024, 1, 1)
WHOLE = ["canonicalCsv", "segmentsCsv"]
YES = {"sourceCompared": True, "leadIdentityVerified": True, "scaleAndGapsReviewed": True}
DECISIONS = "run string, created_at timestamp, decision string, reviewer string, notes string, confirmations map<string,boolean>"


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store", shards=4)
    assert store.get().count() == 0 and store.evidence().count() == 0
    runs = spark.createDataFrame([("a", T, "needs_review", "needs_review", WHOLE, None), ("b", T, "partial", "partial", [], None), ("", T, "partial", None, [], None), ("c", T, "lost", None, [], None), ("d", None, "failed", None, None, 2)], RUNS)
    values = spark.createDataFrame([("a", "s", k, None if k == 3 else float(k)) for k in range(6)] + [("b", "s", 0, 1.0), ("c", "s", 0, 1.0)], SIGNALS)
    broken = {tuple(r) for r in store.add(runs, values).collect()}
    assert broken == {("", "invalid_id"), ("c", "invalid_status"), ("d", "invalid_assets"), ("d", "invalid_time")}
    assert {r["run"]: (r["expected"], r["finite"], r["missing"]) for r in store.evidence().collect()} == {"a": (6, 5, 1), "b": (1, 1, 0)}
    said = spark.createDataFrame([("a", T, "accepted", "me", None, YES), ("b", T, "accepted", "me", None, YES), ("b", T, "rejected", "me", None, None), ("x", T, "rejected", "me", None, None), ("a", T, "accepted", "me", None, {"sourceCompared": True}), ("a", T, "maybe", "me", None, YES)], DECISIONS)
    refused = sorted((r["run"], r["decision"], r["reason"]) for r in store.review(said).collect())
    assert refused == [("a", "accepted", "unconfirmed"), ("a", "maybe", "unknown_decision"), ("b", "accepted", "not_acceptable"), ("x", "rejected", "unknown_run")]
    one = store.get(spark.createDataFrame([("a",)], "run string")).collect()
    assert [(r["run"], r["review"]) for r in one] == [("a", "accepted")]
    assert {r["run"]: (r["review"], r["status"]) for r in store.get().collect()} == {"a": ("accepted", "completed"), "b": ("rejected", "partial")}


def test_records_and_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 2.5, None), ("r2", None, "é \"x\"")], "run string, rate double, note string")
    path = f"file://{tmp_path}/records"
    signals.write_records(rows, "run", path)
    assert {tuple(r) for r in signals.read_records(spark, path, "run string, rate double, note string").collect()} == {tuple(r) for r in rows.collect()}
    spark.createDataFrame([("no record",)], "value string").write.text(f"{path}/shard=zz")
    assert [r["value"] for r in signals.broken_records(spark, path, "run string, rate double, note string").collect()] == ["no record"]
    assert signals.read_records(spark, path, "run string, rate double, note string").count() == 2
    wide = spark.createDataFrame([(0, 1.25, None), (2, None, -3.0)], "sample long, I double, II double")
    signals.write_wide(wide, f"file://{tmp_path}/wide", ["I", "II"], 4)
    back = signals.read_wide(spark, f"file://{tmp_path}/wide", ["I", "II"])
    assert back.count() == 4 and back.agg(F.sum("I"), F.sum("II")).first()[:] == (1.25, -3.0)
