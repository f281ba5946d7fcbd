"""Kernels against plain searches, and the streaming twins against batches."""

import time
from fractions import Fraction
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import kernels
from lacuna.operators import grouped
from lacuna.streaming import events


def test_path_is_the_cheapest():
    rng = np.random.default_rng(1)
    cost = rng.random((4, 5))
    want = min(sum(cost[y, x] for x, y in enumerate(p)) + sum(0.1 * abs(a - b) + 0.02 * (a - b) ** 2 for a, b in zip(p[:-1], p[1:], strict=True)) for p in product(range(4), repeat=5))
    p = kernels.best_path(cost, 0.1, 0.02)
    assert sum(cost[y, x] for x, y in enumerate(p)) + sum(0.1 * abs(a - b) + 0.02 * (a - b) ** 2 for a, b in zip(p[:-1], p[1:], strict=True)) == pytest.approx(want)


def test_path_splits_at_empty_columns():
    cost = np.zeros((2, 3))
    cost[:, 1] = np.inf
    assert kernels.best_path(cost, 1, 0).tolist() == [0, -1, 0]


def test_probability_path_centroid():
    p = np.full((7, 4), 0.01)
    p[3] = 0.9
    assert kernels.probability_path(p, np.ones_like(p, bool)) == pytest.approx([3] * 4, abs=0.05)


@pytest.mark.parametrize("scale, shift", [(1.0, 5), (0.99, -7), (1.02, 0)])
def test_alignment_finds_the_hypothesis(scale, shift):
    rng = np.random.default_rng(2)
    v = np.convolve(rng.normal(size=400), np.ones(9) / 9, "same") * 100
    ref = kernels._affine(v, scale, shift)
    got = kernels.align(ref, v + 40)
    assert got[:2] == (scale, shift) and got[2] == pytest.approx(40, abs=1e-6) and got[3] < 1e-6


def test_peaks_by_distance_and_prominence():
    v = np.array([0, 5, 0, 4, 3.9, 4.5, 0, 9, 0.0])
    assert kernels.peaks(v, 1, 1, 1) == [1, 5, 7] and kernels.peaks(v, 3, 1, 1) == [1, 7]


def test_clusters_and_refractory():
    assert kernels.event_clusters([(0.0, 1), (0.1, 2), (5.0, 1), (5.05, 1)], 0.5, 2) == [(0.05, 2)]
    assert kernels.refractory([(0, 5), (1, 9), (10, 1)], 2) == [(1, 9), (10, 1)]


def test_exact_weights():
    got = kernels.exact_resample([0.0, 0.1], [0.0, 1.0], Fraction(1, 20))
    assert [g[0] for g in got] == [0, 1, 2] and got[1][1] == pytest.approx(0.5) and got[0][2] == 0


def test_median_bounds():
    assert kernels.median_bounds([1, 2, 3]) == (2, 2) and kernels.median_bounds([1, None, 3]) == (1, 3)


def test_period():
    assert kernels.autocorrelation_period(np.sin(np.arange(200) * 2 * np.pi / 10)) == pytest.approx(10, abs=0.1)


def test_grouped_forms(spark):
    v = np.sin(np.arange(64) * 2 * np.pi / 6.0)
    df = spark.createDataFrame([(s, k, float(v[k]) * 100 + s) for s in (1, 2) for k in range(64)], "series long, sample int, value double")
    pairs = spark.createDataFrame([(1, 2)], "a long, b long")
    r = grouped.aligned_pairs(grouped.series_arrays(df, "series"), pairs).first()
    assert r["shift"] == 0 and r["scale"] == 1.0 and r["offset"] == pytest.approx(1) and r["rmse"] < 1e-9
    assert {r["period"] > 5.9 for r in grouped.periods(df, "series").collect()} == {True}
    assert grouped.peaks(df, "series", 3, 50.0, 10.0).count() > 10
    ev = df.select(F.lit(1).cast("long").alias("page"), F.col("sample").cast("double").alias("time"), "series").where("sample % 20 = 0")
    assert [r["n"] for r in grouped.clusters(ev, "page", 2.0, 2).orderBy("time").collect()] == [2, 2, 2, 2]
    pn = spark.createDataFrame([(1, x, 20, 20.0, [0.0, 1.0, 0.0]) for x in range(5)] + [(2, x, 0, 2.0, [0.5, 0.5, 0.5]) for x in range(3)], "panel long, x int, y_start int, row_center double, evidence array<double>")
    assert {(r["panel"], r["y"]) for r in grouped.traced(pn).collect()} == {(1, 21), (2, 2)}  # where the ink is; without any, at the centre
    ex = spark.createDataFrame([(1, 0.0, 0.0), (1, 1.0, 2.0)], "k long, position double, value double")
    assert grouped.exact(ex, "k").count() == 21


def test_seven_rows_of_a_page():
    rng = np.random.default_rng(4)
    profile = rng.random(900) * 0.2
    rows = 100 + 115 * np.arange(7)
    profile[rows] = 1 + rng.random(7) * 0.1
    others = np.array([37, 333, 511, 640])
    profile[others] = 0.9
    chosen, score = kernels.seven_rows(profile, np.sort(np.concatenate([rows, others])), 900)
    assert chosen == tuple(rows.tolist()) and score > 0.8
    assert kernels.seven_rows(profile, rows[:6], 900) == (None, 0.0)
    low, _ = kernels.seven_rows(profile, np.sort(np.concatenate([rows, others])), 9000)
    assert low is not None  # every choice ends too high on so tall a page, the spacing still decides


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, 2, "accepted"), (1, 1, "rejected"), (2, 1, "rejected")], "run long, seq int, decision string").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("run long, seq int, decision string").parquet(f"{tmp_path}/in")
    q = events.latest_reviews(src).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(tuple(r) for r in spark.table("latest").collect()) == [(1, 2, "accepted", 2), (2, 1, "rejected", 1)]
    done = events.intake(src, f"{tmp_path}/out", f"{tmp_path}/cp", lambda b: b.where("decision = 'accepted'"))
    assert done.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1
    spark.createDataFrame([(1, "a", 0.0), (1, "b", 5.0), (1, "b", 20.0)], "run long, owner string, ts double").write.parquet(f"{tmp_path}/claims")
    c = spark.readStream.schema("run long, owner string, ts double").parquet(f"{tmp_path}/claims")
    q = events.leases(c, 10.0).writeStream.outputMode("append").format("memory").queryName("leases").start()  # the timer of the state keeps the query alive
    until = time.time() + 90
    while spark.table("leases").count() < 3 and time.time() < until and q.isActive:
        time.sleep(1)
    q.stop()
    assert [r["granted"] for r in spark.table("leases").orderBy("ts").collect()] == [True, False, True]
