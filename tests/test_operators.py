"""Small cases of the operators: edges, ties, nulls, empty tables."""

import pytest
from pyspark.sql import functions as F

from lacuna.functions import gates, geometry, text
from lacuna.operators import evidence, islands, quality, resample, selection


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def series(spark, values):
    return spark.createDataFrame([(1, k, v) for k, v in values], "series int, sample int, value double")


def test_gaps_interior_only(spark):
    s = series(spark, [(0, 1.0), (1, 1.0), (5, 2.0), (6, 1.0), (9, 0.0)])
    assert rows(islands.gaps(s, ["series"])) == [(1, 2, 5, 3), (1, 7, 9, 2)]


def test_gaps_of_nothing_and_one(spark):
    assert rows(islands.gaps(series(spark, []), ["series"])) == []
    assert rows(islands.gaps(series(spark, [(3, 1.0)]), ["series"])) == []


def test_spans_break_on_status_and_hole(spark):
    s = series(spark, [(0, 1.0), (1, 1.0), (2, 2.0), (4, 2.0)]).withColumn("s", F.col("value").cast("int"))
    assert rows(islands.spans(s, ["series"], ["s"])) == [(1, 1, 0, 2, 2), (1, 2, 2, 3, 1), (1, 2, 4, 5, 1)]


def test_merged_and_covered(spark):
    i = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 8, 9)], "series int, start int, end int")
    assert rows(islands.merged(i, ["series"])) == [(1, 0, 5), (1, 8, 9)]
    got = islands.in_intervals(series(spark, [(k, 0.0) for k in range(10)]), i, ["series"], 4)
    assert [r[1] for r in rows(got.where("covered"))] == [0, 1, 2, 3, 4, 8]


def test_resample_never_bridges_a_gap(spark):
    s = series(spark, [(0, 0.0), (1, 10.0), (5, 4.0)])
    got = rows(resample.resample_runs(s, ["series"], 2.0).select("target", "value"))
    assert got == [(0, 0.0), (1, 5.0), (2, 10.0), (10, 4.0)]


def test_nearest_takes_the_earlier_of_two(spark):
    a = spark.createDataFrame([(1, 5), (1, 100), (2, 7)], "k int, sample int")
    b = spark.createDataFrame([(1, 3), (1, 7), (1, 90)], "k int, sample int")
    assert rows(resample.nearest(a, b, ["k"]).select("k", "sample", F.coalesce("near", F.lit(-1)))) == [(1, 5, 3), (1, 100, 90), (2, 7, -1)]


def test_alignment_trims_and_removes_offset(spark):
    p = spark.createDataFrame([(1, float(k), float(k) + 5 + (1000 if k == 7 else 0), 100) for k in range(100)], "k int, a double, b double, n int")
    r = resample.alignment_metrics(p, ["k"], F.lit(100)).first()
    assert (r["overlap"], r["offset"], r["rmse"]) == (100, 5.0, 0.0)


def test_staged_filter_is_skipped_when_nothing_is_left(spark):
    d = spark.createDataFrame([(1, "a", 3), (1, "b", 1), (2, "b", 9)], "run int, kind string, cost int")
    kept = selection.staged(d, ["run"], [F.col("kind") == "a"])
    assert rows(kept) == [(1, "a", 3), (2, "b", 9)]


def test_first_match_prefers_the_narrower_level(spark):
    d = spark.createDataFrame([(1, "x"), (2, "y")], "id int, k string")
    near, wide = spark.createDataFrame([(1, 0.5)], "id int, p double"), spark.createDataFrame([("x", 0.1), ("y", 0.2)], "k string, p double")
    got = selection.first_match(d, [("near", near, ["id"]), ("wide", wide, ["k"])], "p").select("id", "p", "level")
    assert rows(got) == [(1, 0.5, "near"), (2, 0.2, "wide")]


def test_gap_repair_is_all_or_nothing(spark):
    mine = series(spark, [(0, 0.0), (3, 0.0), (6, 0.0)])
    peers = spark.createDataFrame([(1, p, k, float(p)) for p in (1, 2) for k in range(5)], "series int, peer int, sample int, value double")
    got = selection.repaired(mine, peers, islands.gaps(mine, ["series"]), ["series"], 3, 5.0)
    assert rows(got.select("sample", "value")) == [(1, 1.5), (2, 1.5)]


def test_status_precedence(spark):
    d = spark.createDataFrame([(True, True, None), (False, True, None), (False, False, 80.0), (True, False, 80.0), (False, False, 75.0)], "a boolean, m boolean, s double")
    got = [r[0] for r in d.select(gates.status_of_sample(F.col("a"), F.col("m"), F.col("s"))).collect()]
    assert got == ["uncertain_annotation", "missing", "uncertain_candidate_disagreement", "uncertain_annotation_and_disagreement", "observed"]


def test_admission_counts_active_reservations_only(spark):
    r = spark.createDataFrame([(1, 1, True, 1), (1, 2, False, 1), (1, 3, True, 1)], "host int, at int, active boolean, size_bytes long")
    got = evidence.admitted(r, ["host"], F.lit(7 << 30), [F.col("at")], F.col("active")).select("at", "in_use", "admitted")
    assert rows(got) == [(1, 0, True), (2, 1 << 30, True), (3, 1 << 30, True)]


def test_index_must_match_one_to_one(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ([1, 2, 2, 3], [2, 3, 4]))
    assert rows(evidence.matched_index(a, b, ["k"])) == [(1, "not_described"), (2, "duplicate"), (4, "not_published")]


def test_violations_count_null_as_broken(spark):
    d = spark.createDataFrame([(1, None), (2, 3)], "id int, x int")
    assert rows(evidence.violations(d, ["id"], {"positive": F.col("x") > 0})) == [(1, "positive")]


def test_homography_round_trip(spark):
    m = geometry.matrix(*(F.lit(float(x)) for x in (2, 1, 3, 0, 2, 1, 0.01, 0, 1)))
    p = geometry.project(m, F.lit(4.0), F.lit(5.0))
    q = spark.range(1).select(geometry.project(geometry.inverse(m), p["x"], p["y"]).alias("q")).first()["q"]
    assert q["x"] == pytest.approx(4) and q["y"] == pytest.approx(5)


def test_names(spark):
    r = spark.range(1).select(text.safe_stem(F.lit("__a b/c__")), text.safe_stem(F.lit("//")), text.clean_file_name(F.lit(' a:b  c ')), text.media_type(F.lit("x.PNG")), text.ancestry(F.array(F.lit("b+a"), F.lit("a+c")))).first()
    assert list(r) == ["a_b_c", "signal", "a-b c", "image/png", ["a", "b", "c"]]


def test_histogram_percentile(spark):
    b = spark.createDataFrame([(1, 0, 5), (1, 3, 4), (1, 9, 1)], "k int, bin int, count long")
    assert rows(quality.histogram_percentile(b, ["k"], 0.9)) == [(1, 3)]
