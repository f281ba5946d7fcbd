"""Queries that have no SQL, on small tables against plain versions."""

import random
from itertools import combinations

import numpy as np
import pytest

from pyspark.sql import functions as F

from lacuna import queries, queries_alignment, queries_more  # noqa: F401
from lacuna.functions import kernels
from lacuna.operators import islands, panels, paths


def embeddings(spark, tmp_path, rows):
    spark.createDataFrame(rows, "vec_id long, label long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def test_compact_segments(spark, tmp_path):
    rows = [(k, k % 2, [float(100 * k + s) for s in range(5 + k % 3)]) for k in (0, 1, 2, 3, 5, 9, 10)]
    want = {}
    for k, _, values in rows:
        for s, x in enumerate(values):
            want.setdefault((k // 4, s), [None] * 4)[k % 4] = x
    got = queries.QUERIES["compact_segments"](spark, embeddings(spark, tmp_path, rows)).collect()
    assert {(r["page"], r["local_sample"]): [r["c0"], r["c1"], r["c2"], r["c3"]] for r in got} == want and len(got) == len(want)
    assert all(r["t"] == r["local_sample"] / 500.0 for r in got)


def test_aligned_series(spark, tmp_path):
    rng = random.Random(2)
    wave = [rng.gauss(0, 1) for _ in range(90)]
    rows = [(k, k % 2, [float(np.float32(x)) for x in (wave[7:71] if k == 4 else wave[:64] if k == 0 else [rng.gauss(0, 1) for _ in range(64)])]) for k in range(7)]
    got = {(r["a"], r["b"]): r for r in queries.QUERIES["aligned_series"](spark, embeddings(spark, tmp_path, rows)).collect()}
    values = {k: np.array(v) for k, _, v in rows}
    assert set(got) == {(a, b) for a, b in combinations(range(7), 2) if a % 2 == b % 2}  # not neighbours alone
    for (a, b), r in got.items():
        scale, shift, offset, rmse = kernels.align(values[a], values[b])
        assert (r["scale"], r["shift"]) == (scale, shift) and r["rmse"] == pytest.approx(rmse) and r["offset"] == pytest.approx(offset)
    assert abs(got[0, 4]["shift"]) == 7 and got[0, 4]["scale"] == 1.0


def test_repeated_rows_stay(spark):
    samples = spark.createDataFrame([(1, 3, 0.5), (1, 3, 0.5), (1, 3, 0.5), (1, 40, None), (2, 3, 1.0)], "series int, sample int, value double")
    intervals = spark.createDataFrame([(1, 0, 4), (1, 2, 5), (1, 8, 9), (1, 33, 41), (1, 7, 7)], "series int, start int, end int")
    got = islands.in_intervals(samples, intervals, ["series"], 16)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, 3, 0.5, True)] * 3 + [(1, 40, None, True), (2, 3, 1.0, False)]))
    boxes = spark.createDataFrame([(1, 0, 10, 5.0), (1, 0, 10, 5.0), (2, 590, 640, 79.0)], "box int, x0 int, x1 int, cy double")
    rows = spark.createDataFrame([(0, 0.0), (1, 10.0), (2, 80.0)], "row int, center double")
    got = panels.mapped_boxes(boxes, rows, 600, 4, 5)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 0, 0, 15), (1, 0, 0, 0, 15), (2, 2, 3, 585, 600)]
    assert panels.mapped_boxes(boxes, rows.limit(0), 600, 4, 5).count() == 0


def test_path_gaps_are_not_bridged(spark):
    path = spark.createDataFrame([(1, x, float(10 * x), x not in (3, 7)) for x in range(10)] + [(2, 4, 1.0, True)], "series int, x int, y double, valid boolean")
    got = {r["target"]: r["value"] for r in paths.canonical(path, ["series"], F.lit(0), F.lit(10), 19, F.lit(1.0), F.lit(1000.0)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 8, 9, 10, 11, 12, 16, 17, 18}  # two samples a column; columns 3 and 7 are missing
    assert got[1] - got[0] == pytest.approx(-5.0) and len({r["series"] for r in paths.canonical(path, ["series"], F.lit(0), F.lit(10), 19, F.lit(1.0), F.lit(1.0)).collect()}) == 1


def test_trust_needs_an_independent_peer(spark):
    from lacuna.operators import trust
    from lacuna.sources import trust_views

    lines = [(1, line, part, supp) for line, (part, supp) in enumerate([(1, 1), (2, 9), (3, 4), (4, 4)], 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").createOrReplaceTempView("few_lines")
    c = spark.table("few_lines").selectExpr(*(f"{e} AS `{n}`" for n, e in trust_views.COLUMNS.items()))
    leads = c.selectExpr("run", "id", "0L AS lead", "TRUE AS in_layout", "400 AS expected", "400 AS finite", "0 AS outside", "0 AS errors", "TRUE AS unbroken", "0 AS lead_excursions", "0 AS lead_jumps")
    c = c.withColumn("layout", F.lit("standard_6x2")).withColumn("kind", F.lit(None).cast("string")).withColumn("crop", F.lit(None).cast("string")).withColumn("canonical", F.lit(True)).withColumn("passed", F.lit(True)).withColumn("timing_confirmed", F.lit(None).cast("boolean"))
    c = c.withColumn("semantic_confirmed", F.lit(True)).withColumn("semantic_order", F.lit("standard")).withColumn("semantic_method", F.lit("labels")).withColumn("label_thresh", F.lit(None).cast("double"))
    c = c.withColumn("vectorizer", F.when(F.col("id") < 3e11, "native-grid-path").otherwise("dynamic-path"))
    ids = [r["id"] for r in c.orderBy("id").select("id").collect()]
    pairs = spark.createDataFrame([(1, ids[0], ids[1], 0, 1.0), (1, ids[1], ids[2], 0, 75.0), (1, ids[0], ids[3], 0, 75.1)], "run long, a long, b long, lead long, rmse double")
    got = {r["id"] for r in trust.trusted(c, leads, pairs).collect()}
    assert got == {ids[1], ids[2]}  # two native traces don't prove each other, and 75.1 is too far
    alone = c.where(F.col("id") == ids[0])
    assert trust.trusted(alone, leads, pairs).count() == 0 and trust.trusted(c.limit(0), leads, pairs).count() == 0
