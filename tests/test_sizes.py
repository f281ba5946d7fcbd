"""Steps that must not grow beyond their input: their plans, and the same results as plain loops."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lacuna import queries, queries_fields, queries_ranges, queries_source, queries_trust  # noqa: F401
from lacuna.operators import ranges, resample

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_affine_sample_shuffles_series_only(spark):
    values = {(1, 0): 1.0, (1, 1): 3.0, (1, 2): None, (1, 4): 2.0, (1, 5): 8.0, (2, 3): 5.0}
    df = spark.createDataFrame([(k, s, v) for (k, s), v in values.items()], "k long, sample int, value double")
    tried = [(0, 1.0, 0), (1, 1.0, -1), (2, 0.98, 1), (3, 1.02, 0)]
    made = resample.affine_sample(df, ["k"], spark.createDataFrame(tried, "hyp int, scale double, shift int"), F.lit(2.5), F.lit(6))
    want = {}
    for (k, s) in values:
        for hyp, scale, shift in tried:
            at = 2.5 + (s - 2.5) * scale + shift
            lo = math.floor(at)
            if (k, lo) in values and at <= 5:
                v0, v1 = values[k, lo], values.get((k, lo + 1))
                want[k, hyp, s] = v0 if at == lo else None if v0 is None or v1 is None else v0 + (v1 - v0) * (at - lo)
    assert {(r.k, r.hyp, r.sample): r.value for r in made.collect()} == want
    assert "Join" not in plan(made)  # samples times hypotheses met their neighbours by a join


def test_prefix_sums_of_pages_and_rows(spark):
    pages = spark.createDataFrame([(1, 4, True), (2, 3, True), (3, 2, False)], "k long, width int, on boolean")
    columns = spark.createDataFrame([(1, 0, 0, 1.0), (1, 0, 2, 1.0), (1, 1, 3, 0.1), (1, 1, 9, 1.0), (2, 0, 1, None), (3, 0, 1, 1.0)], "k long, row int, x int, ink double")
    rows = ranges.prefixed(columns, pages, ["k"], ["k", "row"], {"a": F.col("ink") >= 0.5, "b": F.col("on")}).collect()
    assert {(r.k, r.row): (r.a, r.b) for r in rows} == {(1, 0): ([0, 1, 1, 2, 2], [0, 1, 1, 2, 2]), (1, 1): ([0] * 5, [0, 0, 0, 0, 1]), (2, 0): ([0] * 4, [0, 0, 1, 1]), (3, 0): ([0, 0, 1], [0] * 3)}
    whole = ranges.prefixed(columns.where("k = 1 and row = 0").drop("row"), pages, ["k"], ["k"], {"a": F.col("ink") >= 0.5}).collect()
    assert {r.k: r.a for r in whole} == {1: [0, 1, 1, 2, 2], 2: [0] * 4, 3: [0] * 3}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["six_by_two_ranges", "three_by_four_ranges", "twelve_row_consensus", "twelve_row_origins", "twelve_row_spans", "global_timing_disagrees"])
def test_pages_are_never_broadcast(spark, name):
    assert "Broadcast" not in plan(queries.QUERIES[name](spark, DATA))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_points_are_not_grouped_nor_joined_with_themselves(spark):
    text = plan(queries.QUERIES["paper_places"](spark, DATA))
    assert text.count("Join ") <= 2  # each time with the squares of the mesh


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_ways_of_paths_are_not_broadcast(spark):
    assert plan(queries.QUERIES["paper_signals"](spark, DATA)).count("SortMergeJoin") >= 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_leads_are_not_shuffled(spark):
    text = plan(queries.QUERIES["lead_gates"](spark, DATA))
    before, generated = text.count("Exchange hashpartitioning"), text.index("Generate explode")
    assert before == text.count("REPARTITION_BY_NUM") and "Exchange" in text[generated:]  # candidates are, below the generator


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["conservative_peers", "complete_agreement", "lead_identity", "trusted_leads", "low_resolution_corroboration", "native_corroboration"])
def test_candidates_are_dealt_by_run_alone(spark, name):
    dealt = [line for line in plan(queries.QUERIES[name](spark, DATA)).splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and all("REPARTITION_BY_NUM" in line for line in dealt)  # neither leads nor pairs, which are many times as many


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_paths_are_dealt_by_rows_before_they_meet_domains(spark, monkeypatch):
    from lacuna import queries_curves

    assert len(queries.QUERIES["curve_connections"](spark, DATA).collect()) == (n := spark.read.parquet(f"{DATA}/customer.parquet").count())
    monkeypatch.setattr(queries_curves, "ROWS_IN_PART", 5)
    made = queries.QUERIES["curve_connections"](spark, DATA)
    text = plan(made)
    assert made.rdd.getNumPartitions() == -(-n // 5) > spark.sparkContext.defaultParallelism  # one file is one task, whatever its rows become
    assert text.count("Exchange hashpartitioning") == text.count("REPARTITION_BY_NUM") == 2  # their pieces stay where they are


def test_intervals_take_their_margins_once(spark):
    from lacuna.functions import curves

    margins = F.transform("m", lambda v: F.struct((v * 7777).alias("a"), (v - 1).alias("b"), (v + 0.5).alias("c")))
    made = spark.createDataFrame([([-1.0, 2.0],), ([],), (None,)], "m array<double>").select(curves.positive_intervals(margins).alias("i"))
    assert plan(made.select(F.to_json("i"))).count("7777") == 1  # named again, they were worked out for every piece
    got = [r.i for r in made.collect()]
    assert [tuple(i) for i in got[1]] == [(0.0, 1.0)] and got[2] is None
    fits = lambda t: all((v * 7777 * t + v - 1) * t + v + 0.5 >= 0 for v in (-1.0, 2.0))
    assert all(fits(t) == any(lo < t < hi for lo, hi in got[0]) for t in (k / 97 for k in range(1, 97)))


def test_pairs_agree_packed_or_by_lead(spark):
    from lacuna.operators import trust

    by_lead = spark.createDataFrame([(1, 5, 7, 0, 10.0), (1, 5, 7, 1, 80.0), (1, 7, 9, 0, None)], "run long, a long, b long, lead long, rmse double")
    got = {(r.run, r.id, r.peer): sorted((m.lead, m.rmse) for m in r.leads) for r in trust.directed(by_lead).collect()}
    assert got == {(1, 5, 7): [(0, 10.0), (1, 80.0)], (1, 7, 5): [(0, 10.0), (1, 80.0)], (1, 7, 9): [(0, None)], (1, 9, 7): [(0, None)]}
    assert trust.directed(trust.packed(by_lead)).count() == 4


def _solved(rows):
    """Gauss-Jordan steps over fractions; rows: matrix with two right sides."""
    for i in range(4):
        pivot = next(r for r in range(i, 4) if rows[r][i])
        rows[i], rows[pivot] = rows[pivot], rows[i]
        rows[i] = [v / rows[i][i] for v in rows[i]]
        rows = [r if j == i else [v - r[i] * w for v, w in zip(r, rows[i], strict=True)] for j, r in enumerate(rows)]
    return rows


def test_sides_of_label_boxes_are_halved_exactly(spark):
    from fractions import Fraction

    from lacuna import queries_curves as q
    from lacuna.operators import labels
    from lacuna.plans import policy

    pages = spark.createDataFrame([(327,), (379,), (5219,)], "k long").selectExpr("k", *q._PAGE_OF.split(", "))
    places = [(r, k, n) for r, line in enumerate(policy.LABEL_ROWS) for k, n in enumerate(line)]
    named = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(k).alias("column"), F.lit(n).alias("lead")) for r, k, n in places)))
    points = pages.select("k", named.alias("n")).select("k", "n.*").where(q._THERE).selectExpr("k", "row", "column", "lead", *q._LABEL.split(", ")).cache()
    fits = labels.fit(points.select("k", "lead", "x", "y"), pages, ["k"]).withColumns({"rhythm_x": F.lit(60.0), "rhythm_y": F.lit(540.0)})
    font = {r.k: Fraction(str(r.font)) for r in pages.collect()}
    half, got, halves = Fraction(1, 2), labels.slots(fits, ["k"]).where("row < 3").collect(), 0
    before, over, behind = (Fraction(str(v)) for v in policy.LABEL_GRID["box"])
    at = {}
    for k in font:
        seen = [([1, r.row, r.column, r.row * r.column], Fraction(r.x), Fraction(r.y)) for r in points.where(F.col("k") == k).collect()]
        at[k] = _solved([[Fraction(sum(t[i] * t[j] for t, _, _ in seen)) for j in range(4)] + [sum(t[i] * v[side] for t, *v in seen) for side in (0, 1)] for i in range(4)])
    assert {r.k for r in got} == set(font)
    for r in got:
        x, y = (sum(t * row[side] for t, row in zip([1, r.row, r.column, r.row * r.column], at[r.k], strict=True)) for side in (4, 5))
        want = [x - before * font[r.k], y - over * font[r.k], x + behind * font[r.k], y + over * font[r.k]]
        halves += sum(v % 1 == half for v in want)
        assert [r.left, r.top, r.right, r.bottom] == [round(v) for v in want]
    assert halves


def test_label_slots_say_the_same_at_halves(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    spark.range(320, 380).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/supplier.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL["label_slots"]).fetchall()
    assert want and {tuple(r) for r in queries.QUERIES["label_slots"](spark, str(tmp_path)).collect()} == set(want)


def test_anchor_shifts_match_plain_loops(spark, tmp_path):
    from lacuna import queries_more  # noqa: F401

    views = {1: [0, 43, 44, 90, -30], 2: [500], 3: []}
    buys = {1: [1, 20, 42, 43, 64, -9], 2: [10], 3: [7]}
    rows = [(k, 3600 * t, kind) for kind, found in (("view", views), ("purchase", buys)) for k, hours in found.items() for t in hours]
    spark.createDataFrame(rows, "user_id long, s long, event_type string").selectExpr("user_id", "timestamp_seconds(s) AS ts", "event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    made = queries.QUERIES["anchor_shift"](spark, str(tmp_path))
    assert plan(made).count("Join ") == 1  # purchases with bitmaps of hours; not every shift with every view
    want = {}
    for k, hours in buys.items():
        tried = []
        for shift in range(-20, 21):
            gaps = [min((abs(v - t - shift) for v in views[k]), default=9) for t in hours]
            near = [g for g in gaps if g <= 1]
            tried.append((-len(near), sum(near), abs(shift), shift))
        want[k] = (min(tried)[3], -min(tried)[0])
    assert {r.k: (r.shift, r.matches) for r in made.collect()} == want


def test_pieces_of_ink_over_many_pages_and_batches(spark):
    import itertools
    import random

    from lacuna.operators import source_support

    rng, rows, want = random.Random(3), [], {}
    for page in [("a", 1), ("a", 2), ("b", None), (None, 2**60 + 1), *(("c", k) for k in range(40))]:
        spots = {(y, x): rng.random() < 0.3 for y in range(9) for x in range(11) if rng.random() < 0.3}
        rows += [(*page, x, y, lost) for (y, x), lost in spots.items()]
        left, n = set(spots), 0
        for spot in sorted(spots):
            todo, piece = [spot], []
            while todo:
                y, x = todo.pop()
                if (y, x) in left:
                    left.remove((y, x))
                    piece.append(spots[y, x])
                    todo += [(y + i, x + j) for i, j in itertools.product((-1, 0, 1), repeat=2)]
            if piece:
                want[(*page, n)] = (len(piece), sum(piece))
                n += 1
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "book string, page long, x long, y long, omitted boolean")
    made = source_support.components(df, ["book", "page"])
    assert "FlatMapGroups" not in plan(made)  # a call for each page took most of the time
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "1", "100000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = source_support.components(df, ["book", "page"]).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
        assert len(got) == len(want) and {(r.book, r.page, r.component): (r.pixels, r.omitted) for r in got} == want
    assert source_support.components(df.where("false"), ["book", "page"]).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["ink_components", "source_verification", "supported_points"])
def test_source_pages_are_dealt_before_they_become_pixels(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "REPARTITION_BY_NUM" in text[text.index("Generate posexplode") :]  # pages are, below the generator


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", ["trusted_leads", "complete_agreement", "lead_identity"])
def test_leads_are_bits(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "ObjectHashAggregate" not in text and "SortAggregate" not in text  # sets of leads were sorted, candidate by candidate
    assert text.count("Generate explode(sequence") == (name != "complete_agreement")  # trusted leads aren't unfolded to be counted
    assert text.count("ShuffledHashJoin") <= 13  # 21 and 22 when both ends of a pair worked out their names anew


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_trust_is_the_same_for_pairs_as_bits_packed_or_by_lead(spark, tmp_path):
    from lacuna.operators import trust
    from lacuna.sources import trust_views

    spark.read.parquet(f"{DATA}/lineitem.parquet").where("l_orderkey between 1 and 60 or l_orderkey = 1294").coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")  # 1294 repeats a candidate
    c, leads, pairs = trust_views.tables(spark, str(tmp_path))
    c, leads = c.cache(), leads.cache()
    by_lead = pairs.select("run", "a", "b", F.explode("leads").alias("m")).select("run", "a", "b", "m.*").cache()
    got = {(r.run, r.id, r.lead) for r in trust.trusted(c, leads, by_lead).collect()}
    whole = sorted(tuple(r) for r in trust.complete_agreement(c, spark.createDataFrame(sorted(got), "run long, id long, lead long")).collect())
    assert got and len(whole) == c.select("run").distinct().count()
    for form in (pairs, pairs.drop("near"), by_lead):
        rows = [tuple(r) for r in trust.trusted(c, leads, form).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == got
        agreed = [tuple(r) for r in trust.complete_agreement(c, trust.trusted_bits(c, leads, form)).collect()]
        assert sorted(agreed) == whole
        named = [tuple(r) for r in trust.identified(trust.facts(c), leads, form).collect()]
        assert len(named) == len(set(named)) and got <= set(named)


def test_bits_of_leads(spark):
    from lacuna.functions import candidates as rules
    from lacuna.operators import trust

    df = spark.createDataFrame([(1, 1, k) for k in (0, 11, 62, None)] + [(1, 2, None)], "run long, id long, lead int")
    bits = df.groupBy("run", "id").agg(F.bit_or(rules.lead_bit()).alias("bits"))
    assert {(r.id, r.bits) for r in bits.collect()} == {(1, 1 | 1 << 11 | 1 << 62), (2, None)}
    assert sorted(tuple(r) for r in trust.numbers(bits, "bits").collect()) == [(1, 1, 0), (1, 1, 11), (1, 1, 62)]
    for beyond in (-1, 63):
        with pytest.raises(Exception, match="lead beyond 0 to 62"):  # never another lead's bit
            spark.createDataFrame([(beyond,)], "lead int").select(rules.lead_bit()).collect()
