"""Queries over the driver's tables, one per operator family, each with the same result in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lacuna.functions import gates, geometry, text
from lacuna.operators import evidence, islands, panels, quality, resample, selection
from lacuna.plans import policy
from lacuna.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

V1 = "v1 AS (SELECT vec_id AS series, label AS grp, CAST(unnest(range(0, len(embedding))) AS INT) AS sample, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"
V2 = "v2 AS (SELECT user_id AS series, CAST(floor(epoch_us(ts) / 1e6 / 21600) AS BIGINT) AS sample, round(avg(value), 6) AS value FROM events GROUP BY 1, 2)"
V3 = "v3 AS (SELECT user_id AS series, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS sample, event_type AS candidate, round(avg(value), 6) AS value FROM events GROUP BY 1, 2, 3)"
V7 = "v7 AS (SELECT l_orderkey AS run, l_linenumber AS candidate, l_returnflag AS kind, l_linestatus AS layout, l_quantity AS score, CAST(round(l_discount * 100) AS INT) AS warnings, CAST(round(l_tax * 100) AS INT) AS missing, CAST(l_suppkey % 7 AS INT) AS crop FROM lineitem)"
GAPS = "g AS (SELECT series, sample + 1 AS \"start\", nxt AS \"end\", nxt - sample - 1 AS length FROM (SELECT series, sample, lead(sample) OVER (PARTITION BY series ORDER BY sample) AS nxt FROM v2) WHERE nxt > sample + 1)"


def query(sql: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# gaps, islands, spans


@query(f"WITH {V2}, {GAPS} SELECT * FROM g")
def contiguous_gaps(spark, d):
    return islands.gaps(views.gapped_series(spark, d), ["series"])


@query(f"""WITH {V2}, {GAPS}, m AS (SELECT series, max(length) AS max_gap FROM g GROUP BY 1)
SELECT v2.series, max(sample) - min(sample) + 1 AS expected, count(*) AS finite, max(sample) - min(sample) + 1 - count(*) AS missing,
CAST(coalesce(any_value(max_gap), 0) AS BIGINT) AS max_gap, round(quantile_disc(value, 0.99) - quantile_disc(value, 0.01), 6) AS amplitude FROM v2 LEFT JOIN m ON m.series = v2.series GROUP BY v2.series""")
def qa_per_series(spark, d):
    return quality.series_quality(views.gapped_series(spark, d), ["series"])


@query(f"""WITH {V2}, {GAPS}, s AS (SELECT series, min(sample) AS lo, max(sample) - min(sample) + 1 AS n FROM v2 GROUP BY 1),
r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY length DESC, "start") AS k FROM g WHERE length >= 10)
SELECT r.series, r."start", r.length, CASE WHEN (r."start" - lo) / n::DOUBLE < 0.15 OR (r."start" + r.length - lo) / n::DOUBLE > 1 - 0.15 THEN 'transition' ELSE 'interior' END AS kind FROM r JOIN s USING (series) WHERE k <= 2""")
def qa_gap_warnings(spark, d):
    return quality.gap_warnings(views.gapped_series(spark, d), ["series"])


@query(f"""WITH {V2}, b AS (SELECT series, min(sample) AS lo, max(sample) AS hi FROM v2 GROUP BY 1), f AS (SELECT series, unnest(range(lo, hi + 1)) AS sample FROM b),
s AS (SELECT f.series, f.sample, CASE WHEN value IS NULL THEN 'missing' ELSE 'returned' END AS status FROM f LEFT JOIN v2 USING (series, sample)),
i AS (SELECT *, sample - row_number() OVER (PARTITION BY series, status ORDER BY sample) AS k FROM s)
SELECT series, status, min(sample) AS "start", max(sample) + 1 AS "end", count(*) AS length FROM i GROUP BY series, status, k""")
def support_spans(spark, d):
    full = islands.dense(views.gapped_series(spark, d), ["series"])
    return islands.spans(full.withColumn("status", F.when(F.col("value").isNull(), "missing").otherwise("returned")), ["series"], ["status"])


@query(f"""WITH {V2}, w AS (SELECT *, CASE WHEN sample - lag(sample) OVER o = 1 AND abs(value - lag(value) OVER o) <= 100 THEN 0 ELSE 1 END AS b FROM v2 WINDOW o AS (PARTITION BY series ORDER BY sample)),
r AS (SELECT *, sum(b) OVER (PARTITION BY series ORDER BY sample) AS k FROM w) SELECT series, min(sample) AS "start", max(sample) + 1 AS "end", max(sample) + 1 - min(sample) AS length FROM r GROUP BY series, k""")
def connected_runs(spark, d):
    v = views.gapped_series(spark, d)
    far = F.abs(F.col("value") - F.lag("value").over(Window.partitionBy("series").orderBy("sample"))) > 100
    return islands.spans(v.withColumn("far", far), ["series"], [], breaks=F.col("far"))


@query(f"""WITH {V1}, t AS (SELECT series, sample, sample - row_number() OVER (PARTITION BY series ORDER BY sample) AS k FROM v1 WHERE value > 0)
SELECT series, min(sample) AS "start", CAST(max(sample) + 1 AS INT) AS "end", CAST(count(*) AS INT) AS length FROM t GROUP BY series, k HAVING count(*) >= 2""")
def threshold_runs(spark, d):
    return islands.spans(views.regular_series(spark, d).where("value > 0"), ["series"], []).where("length >= 2").select("series", "start", F.col("end").cast("int"), F.col("length").cast("int"))


@query(f"""WITH {V2}, {GAPS}, p AS (SELECT series, "start" - 2 AS "start", "end" + 2 AS "end" FROM g), w AS (SELECT *, max("end") OVER (PARTITION BY series ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR reach < "start" THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY "start", "end") AS k FROM w) SELECT series, min("start") AS "start", max("end") AS "end" FROM r GROUP BY series, k""")
def merged_intervals(spark, d):
    g = islands.gaps(views.gapped_series(spark, d), ["series"]).select("series", (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end"))
    return islands.merged(g, ["series"])


# panels


LAYOUT = "l AS (SELECT series, count(*) AS n, CASE series % 3 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 1 END AS n_cols, series % 10 = 0 AS rhythm FROM v1 GROUP BY 1), b AS (SELECT series, n, n_cols, rhythm, series % n_cols AS col, n // n_cols AS part FROM l), p AS (SELECT series, CAST(CASE WHEN rhythm THEN 0 ELSE col * part END AS INT) AS \"start\", CAST(CASE WHEN rhythm OR col = n_cols - 1 THEN n ELSE (col + 1) * part END AS INT) AS \"end\" FROM b)"


def _paneled(spark: SparkSession, d: str) -> DataFrame:
    """Each regular series with its panel: four, three or one columns by series, every tenth at full width."""
    v = views.regular_series(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("series")).cast("int"))
    columns = F.when(F.col("series") % 3 == 0, 4).when(F.col("series") % 3 == 1, 3).otherwise(1)
    start, end = panels.panel_bounds(F.col("n"), columns, F.col("series") % columns, F.col("series") % 10 == 0)
    return v.withColumn("start", start).withColumn("end", end)


@query(f'WITH {V1}, {LAYOUT} SELECT series, CAST(sample - "start" AS INT) AS local_sample, value FROM v1 JOIN p USING (series) WHERE sample >= "start" AND sample < "end"')
def panel_slices(spark, d):
    return panels.sliced(_paneled(spark, d)).select("series", "local_sample", "value")


@query(f'WITH {V1}, {LAYOUT} SELECT series, sample, CASE WHEN sample >= "start" AND sample < "end" THEN value END AS value FROM v1 JOIN p USING (series)')
def sanitized_panels(spark, d):
    return panels.sanitized(_paneled(spark, d)).select("series", "sample", "value")


@query(f"""WITH {V1}, q AS (SELECT series, count(value) >= 20 AND quantile_disc(value, 0.99) - quantile_disc(value, 0.01) < 0.5 AS flat FROM v1 GROUP BY 1) SELECT series, sample, flat, CASE WHEN NOT flat THEN value END AS value FROM v1 JOIN q USING (series)""")
def near_flat_suppression(spark, d):
    return panels.without_near_flat(views.regular_series(spark, d), ["series"], 0.5).select("series", "sample", "flat", "value")


@query(f"""WITH {V1}, {LAYOUT} SELECT series, sample, CASE WHEN sample - "start" < ceil(("end" - "start") * 0.1::DOUBLE) OR sample - "start" >= "end" - "start" - ceil(("end" - "start") * 0.03::DOUBLE) THEN NULL ELSE value END AS value FROM v1 JOIN p USING (series) WHERE sample >= "start" AND sample < "end" """)
def panel_boundary_masks(spark, d):
    inside = panels.sliced(_paneled(spark, d))
    return panels.without_boundaries(inside, F.col("end") - F.col("start"), F.col("local_sample")).select("series", "sample", "value")


@query(f"""WITH {V1} SELECT series // 4 AS page, sample AS local_sample, sample / 500.0::DOUBLE AS t, max(value) FILTER (series % 4 = 0) AS c0, max(value) FILTER (series % 4 = 1) AS c1, max(value) FILTER (series % 4 = 2) AS c2, max(value) FILTER (series % 4 = 3) AS c3 FROM v1 GROUP BY 1, 2""")
def compact_segments(spark, d):
    v = views.regular_series(spark, d).select(F.floor(F.col("series") / 4).alias("page"), F.concat(F.lit("c"), F.pmod("series", F.lit(4))).alias("channel"), F.col("sample").alias("local_sample"), "value")
    return panels.compact(v, ["c0", "c1", "c2", "c3"], 500.0, ("page",))


@query(f"""WITH {V2}, {GAPS}, a AS (SELECT series, sample, value FROM v2), i AS (SELECT series, "start" - 3 AS s, "start" AS e FROM g) SELECT a.series, a.sample, EXISTS (SELECT 1 FROM i WHERE i.series = a.series AND a.sample >= i.s AND a.sample < i.e) AS covered, CASE WHEN EXISTS (SELECT 1 FROM i WHERE i.series = a.series AND a.sample >= i.s AND a.sample < i.e) THEN NULL ELSE value END AS kept FROM a""")
def annotated_samples(spark, d):
    v = views.gapped_series(spark, d)
    near = islands.gaps(v, ["series"]).select("series", (F.col("start") - 3).alias("start"), F.col("start").alias("end"))
    return islands.in_intervals(v, near, ["series"], 16).select("series", "sample", "covered", F.when(~F.col("covered"), F.col("value")).alias("kept"))


BOXES = "bx AS (SELECT l_orderkey * 10 + l_linenumber AS box, CAST(l_quantity * 10 AS INT) AS x0, CAST(l_quantity * 10 AS INT) + 40 AS x1, l_extendedprice / 100 AS cy FROM lineitem), rw AS (SELECT CAST(n_nationkey AS INT) AS row, CAST(n_nationkey * 40 AS DOUBLE) AS center FROM nation)"


@query(f"""WITH {BOXES}, m AS (SELECT box, x0, x1, row, row_number() OVER (PARTITION BY box, x0, x1, cy ORDER BY abs(cy - center), row) AS k FROM bx, rw)
SELECT box, row, CAST(least(3, floor((x0 + x1) / 2.0::DOUBLE / 600 * 4)) AS INT) AS col, greatest(0, x0 - 5) AS "start", least(600, x1 + 5) AS "end" FROM m WHERE k = 1""")
def annotation_ranges(spark, d):
    li = views.read(spark, d, "lineitem")
    x0 = (F.col("l_quantity") * 10).cast("int")
    boxes = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("box"), x0.alias("x0"), (x0 + 40).alias("x1"), (F.col("l_extendedprice") / 100).alias("cy"))
    rows = views.read(spark, d, "nation").select(F.col("n_nationkey").cast("int").alias("row"), (F.col("n_nationkey") * 40).cast("double").alias("center"))
    return panels.mapped_boxes(boxes, rows, 600, 4, 5)


# quality, uncertainty, disagreement, trust


UNC = "u AS (SELECT series, sample, count(value) AS candidate_count, round(max(value) - min(value), 6) AS spread FROM v3 GROUP BY 1, 2), us AS (SELECT *, CASE WHEN sample % 17 = 0 AND spread > 75 AND candidate_count > 0 THEN 'uncertain_annotation_and_disagreement' WHEN sample % 17 = 0 THEN 'uncertain_annotation' WHEN candidate_count = 0 THEN 'missing' WHEN spread > 75 THEN 'uncertain_candidate_disagreement' ELSE 'observed' END AS status FROM u)"


def _uncertain(spark, d):
    return quality.uncertainty(views.candidates(spark, d), ["series", "sample"], F.col("sample") % 17 == 0)


@query(f"WITH {V3}, {UNC} SELECT * FROM us")
def uncertainty_rows(spark, d):
    return _uncertain(spark, d)


@query(f"""WITH {V3}, {UNC} SELECT series, count(*) FILTER (status LIKE 'uncertain%') AS uncertain, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (contains(status, 'disagreement')) AS disagreements, quantile_disc(spread, 0.95) AS spread_p95, max(spread) AS spread_max FROM us GROUP BY 1""")
def uncertainty_summary(spark, d):
    return quality.uncertainty_summary(_uncertain(spark, d), ["series"])


@query(f"""WITH {V3}, {UNC}, s AS (SELECT series, count(*) FILTER (status LIKE 'uncertain%') AS uncertain, count(*) FILTER (status = 'missing') AS missing, count(*) FILTER (contains(status, 'disagreement')) AS dis FROM us GROUP BY 1)
SELECT series, uncertain, missing, CASE WHEN missing > 0 OR dis > 0 OR uncertain > dis THEN 'lower' ELSE 'standard' END AS confidence, concat_ws(',', CASE WHEN missing > 0 THEN 'missing_samples' END, CASE WHEN dis > 0 THEN 'candidate_disagreement' END, CASE WHEN uncertain > dis THEN 'annotation_overlap' END) AS reasons FROM s""")
def reliability_summary(spark, d):
    return quality.reliability(_uncertain(spark, d), ["series"])


GATES = """c AS (SELECT CASE WHEN series % 5 = 0 THEN 'a' ELSE 'b' END AS kind, *, CASE WHEN expected > 0 AND finite >= least(expected, greatest(20, ceil(expected * 0.8::DOUBLE))) AND NOT (finite >= 20 AND amplitude < 20) THEN 1 ELSE 0 END AS ok FROM q)"""
QA = f"""{V2}, {GAPS}, m AS (SELECT series, max(length) AS mg FROM g GROUP BY 1), q AS (SELECT v2.series, max(sample) - min(sample) + 1 AS expected, count(*) AS finite, max(sample) - min(sample) + 1 - count(*) AS missing, CAST(coalesce(any_value(mg), 0) AS BIGINT) AS max_gap, round(quantile_disc(value, 0.99) - quantile_disc(value, 0.01), 6) AS amplitude FROM v2 LEFT JOIN m ON m.series = v2.series GROUP BY v2.series)"""


@query(f"""WITH {QA}, {GATES} SELECT kind, CAST(sum(ok) AS BIGINT) AS scorable, count(*) FILTER (finite >= least(expected, greatest(20, ceil(expected * 0.95::DOUBLE)))) AS complete, count(*) FILTER (finite >= ceil(expected * 0.75::DOUBLE)) AS reviewable, round(min(finite / expected::DOUBLE), 6) AS least_coverage, bool_and(ok = 1) AS all_scorable, CAST(sum(missing) AS BIGINT) AS missing, count(*) FILTER (finite >= 20 AND amplitude < 20) AS errors FROM c GROUP BY 1""")
def candidate_coverage_gates(spark, d):
    q = quality.series_quality(views.gapped_series(spark, d), ["series"]).withColumn("kind", F.when(F.col("series") % 5 == 0, "a").otherwise("b"))
    return quality.candidate_gates(q, ["kind"])


SCORED = "sc AS (SELECT run, candidate, kind, layout, crop, warnings * 10000.0 + missing * 10.0 + score * 100.0 + CASE WHEN kind = 'R' THEN 25000.0 ELSE 0 END AS score, warnings * 10000.0 AS wp FROM v7), rk AS (SELECT *, score - wp + wp * 0.01 AS rank FROM sc)"


def _scored(spark, d):
    p = views.pools(spark, d)
    score = gates.candidate_score(warnings=F.col("warnings"), missing=F.col("missing"), layout_cost=F.col("score"), annotation=(F.col("kind") == "R").cast("int"))
    penalty = F.col("warnings") * 10000.0
    scored = p.select("run", "candidate", "kind", "layout", "crop", "warnings", "missing", score.alias("score"), penalty.alias("wp"))
    return scored.withColumn("rank", gates.publication_rank(F.col("score"), F.col("wp")))


@query(f"WITH {V7}, {SCORED} SELECT run, candidate, round(score, 4)::DOUBLE AS score, round(rank, 4)::DOUBLE AS rank FROM rk")
def candidate_scores(spark, d):
    return _scored(spark, d).select("run", "candidate", F.round("score", 4).alias("score"), F.round("rank", 4).alias("rank"))


PAIRS = """pr AS (SELECT x.series, x.candidate AS a, y.candidate AS b, y.value - x.value AS df FROM v3 x JOIN v3 y ON x.series = y.series AND x.sample = y.sample AND x.candidate < y.candidate), md AS (SELECT series, a, b, quantile_cont(df, 0.5) AS m FROM pr GROUP BY 1, 2, 3), pt AS (SELECT pr.series, pr.a, pr.b, count(*) AS n, sqrt(avg((df - m) * (df - m))) AS rmse FROM pr JOIN md USING (series, a, b) GROUP BY 1, 2, 3), bw AS (SELECT * FROM pt UNION ALL SELECT series, b AS a, a AS b, n, rmse FROM pt)"""


def _pairs(spark, d):
    return quality.pair_rmse(views.candidates(spark, d), ["series"], "candidate", ["sample"])


@query(f"WITH {V3}, {PAIRS} SELECT series, a, b, n, round(rmse, 5) AS rmse FROM pt")
def pair_table(spark, d):
    return _pairs(spark, d).withColumn("rmse", F.round("rmse", 5))


@query(f"WITH {V3}, {PAIRS} SELECT series, a AS candidate, CAST(floor(round(quantile_cont(rmse, 0.5) * 25, 6) + 0.5) AS BIGINT) AS penalty, count(*) AS peers FROM bw GROUP BY 1, 2")
def disagreement_penalty(spark, d):
    pairs = _pairs(spark, d)
    return quality.both_ways(pairs).groupBy("series", F.col("a").alias("candidate")).agg(gates.js_round(F.round(F.expr("percentile(rmse, 0.5)") * policy.DISAGREEMENT_WEIGHT, 6)).cast("long").alias("penalty"), F.count("*").alias("peers"))


@query(f"WITH {V3}, {PAIRS} SELECT DISTINCT series, candidate FROM v3 WHERE EXISTS (SELECT 1 FROM bw WHERE bw.series = v3.series AND bw.a = v3.candidate AND round(rmse, 6) <= 75 AND (bw.a = 'click') <> (bw.b = 'click'))")
def trusted_candidates(spark, d):
    c = views.candidates(spark, d).select("series", "candidate").distinct()
    pairs = _pairs(spark, d).withColumn("rmse", F.round("rmse", 6))
    return quality.trusted(c, pairs, ["series"], "candidate", (F.col("a") == "click") != (F.col("b") == "click"))


@query(f"WITH {V3}, {PAIRS}, t AS (SELECT series, a FROM bw WHERE round(rmse, 6) <= 75 GROUP BY 1, 2) SELECT c.series, count(*) AS n, bool_and(t.a IS NOT NULL) AS all_trusted FROM (SELECT DISTINCT series, candidate FROM v3) c LEFT JOIN t ON t.series = c.series AND t.a = c.candidate GROUP BY 1")
def all_trusted(spark, d):
    c = views.candidates(spark, d).select("series", "candidate").distinct()
    good = quality.both_ways(_pairs(spark, d).withColumn("rmse", F.round("rmse", 6))).where(F.col("rmse") <= policy.DISAGREEMENT).select("series", F.col("a").alias("candidate"), F.lit(True).alias("ok")).distinct()
    return c.join(good, ["series", "candidate"], "left").groupBy("series").agg(F.count("*").alias("n"), F.every(F.coalesce("ok", F.lit(False))).alias("all_trusted"))


@query(f"""WITH {V1}, j AS (SELECT series, grp, value AS y, abs(value) AS ev, value > -1 AS valid, abs(value - lag(value) OVER (PARTITION BY series ORDER BY sample)) AS jump FROM v1)
SELECT series, round(quantile_cont(ev, 0.5), 6) AS evidence_median, round(quantile_cont(ev, 0.1), 6) AS evidence_p10, round(max(jump), 6) AS max_jump, round(quantile_cont(jump, 0.95), 6) AS jump_p95, round(avg(CAST(valid AS INT)), 6) AS coverage, count(*) FILTER (jump > 3) AS large_jumps FROM j GROUP BY 1""")
def path_fidelity(spark, d):
    v = views.regular_series(spark, d).select("series", F.col("sample").alias("x"), F.col("value").alias("y"), F.abs("value").alias("evidence"), (F.col("value") > -1).alias("valid"))
    return quality.fidelity(v, ["series"])


@query("""WITH h AS (SELECT event_type, CAST(least(255, floor(value / 2)) AS INT) AS bin, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY event_type ORDER BY bin) AS run, sum(c) OVER (PARTITION BY event_type) AS tot FROM h) SELECT event_type, min(bin) AS bin FROM r WHERE run >= tot * 0.9::DOUBLE GROUP BY 1""")
def histogram_percentile(spark, d):
    bins = views.read(spark, d, "events").groupBy("event_type", F.least(F.lit(255), F.floor(F.col("value") / 2)).cast("int").alias("bin")).agg(F.count("*").alias("count"))
    return quality.histogram_percentile(bins, ["event_type"], 0.9)


@query(f"""WITH {V1}, q AS (SELECT series, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.995) AS hi FROM v1 GROUP BY 1) SELECT series, sample, round(CASE WHEN hi > lo THEN least(greatest((value - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) AS value FROM v1 JOIN q USING (series)""")
def robust_unit_scale(spark, d):
    return quality.unit_scale(views.regular_series(spark, d), ["series"]).select("series", "sample", F.round("value", 6).alias("value"))


@query(f"""WITH {V1}, w AS (SELECT series // 6 AS page, sample, max(value) FILTER (series % 6 = 0) AS i, max(value) FILTER (series % 6 = 1) AS ii, max(value) FILTER (series % 6 = 2) AS iii FROM v1 GROUP BY 1, 2)
SELECT page, round(quantile_cont(abs(ii - i - iii), 0.5), 6) AS error, round(corr(ii, i + iii), 6) AS r FROM w WHERE i IS NOT NULL AND ii IS NOT NULL AND iii IS NOT NULL GROUP BY 1""")
def limb_identity(spark, d):
    v = views.regular_series(spark, d)
    side = lambda k: F.max(F.when(F.col("series") % 6 == k, F.col("value")))
    w = v.groupBy(F.floor(F.col("series") / 6).alias("page"), "sample").agg(side(0).alias("i"), side(1).alias("ii"), side(2).alias("iii")).where("i is not null and ii is not null and iii is not null")
    return w.groupBy("page").agg(F.round(F.expr("percentile(abs(ii - i - iii), 0.5)"), 6).alias("error"), F.round(F.corr(F.col("ii"), F.col("i") + F.col("iii")), 6).alias("r"))


@query(f"""WITH {V1}, m AS (SELECT series, avg(value) AS mu FROM v1 GROUP BY 1), c AS (SELECT series, sample, value - mu AS z FROM v1 JOIN m USING (series)), e AS (SELECT series, sum(z * z) AS e FROM c GROUP BY 1),
l AS (SELECT a.series, b.sample - a.sample AS lag, sum(a.z * b.z) / any_value(e) AS r FROM c a JOIN c b ON a.series = b.series AND b.sample - a.sample BETWEEN 2 AND 31 JOIN e ON e.series = a.series WHERE e > 0 GROUP BY 1, 2),
k AS (SELECT *, lag(r) OVER o AS r0, lead(r) OVER o AS r1 FROM l WINDOW o AS (PARTITION BY series ORDER BY lag)) SELECT series, min(lag) AS period FROM k WHERE round(r, 9) >= 0.18 AND r > r0 AND r > r1 GROUP BY 1""")
def grid_period(spark, d):
    v = views.regular_series(spark, d)
    w = Window.partitionBy("series")
    z = v.withColumn("z", F.col("value") - F.avg("value").over(w)).withColumn("e", F.sum(F.col("z") * F.col("z")).over(w)).where("e > 0")
    o = w.orderBy("sample")
    lags = z.select("series", "e", *[(F.col("z") * F.lead("z", k).over(o)).alias(f"p{k}") for k in range(2, 32)])
    sums = lags.groupBy("series", "e").agg(*[(F.sum(f"p{k}")).alias(f"p{k}") for k in range(2, 32)]).unpivot(["series", "e"], [f"p{k}" for k in range(2, 32)], "name", "p")
    r = sums.select("series", F.substring("name", 2, 2).cast("int").alias("lag"), (F.col("p") / F.col("e")).alias("r")).where("r is not null")
    ow = Window.partitionBy("series").orderBy("lag")
    return r.withColumn("r0", F.lag("r").over(ow)).withColumn("r1", F.lead("r").over(ow)).where((F.round("r", 9) >= 0.18) & (F.col("r") > F.col("r0")) & (F.col("r") > F.col("r1"))).groupBy("series").agg(F.min("lag").alias("period"))


# resampling, alignment, repair


@query(f"""WITH {V1}, h AS (SELECT CAST((i * 41 + k + 20) AS INT) AS hyp, sc AS scale, CAST(k AS INT) AS shift FROM (SELECT unnest(range(5)) AS i, unnest([1.0::DOUBLE, 0.99::DOUBLE, 1.01::DOUBLE, 0.98::DOUBLE, 1.02::DOUBLE]) AS sc), (SELECT unnest(range(-20, 21)) AS k)),
x AS (SELECT series, hyp, sample, 31.5::DOUBLE + (sample - 31.5::DOUBLE) * scale + shift AS pos FROM v1, h), y AS (SELECT *, CAST(floor(pos) AS INT) AS lo FROM x WHERE pos <= 63 AND pos >= 0),
s AS (SELECT y.series, y.hyp, y.sample, CASE WHEN pos = lo THEN p.value ELSE p.value + (q.value - p.value) * (pos - lo) END AS value FROM y JOIN v1 p ON p.series = y.series AND p.sample = y.lo LEFT JOIN v1 q ON q.series = y.series AND q.sample = y.lo + 1)
SELECT series, hyp, count(value) AS n, round(sum(value), 5) AS total, round(max(value), 6) AS top FROM s GROUP BY 1, 2""")
def affine_samples(spark, d):
    """All hypotheses of the policy; of each its samples counted, summed and their largest."""
    v = views.regular_series(spark, d).select("series", "sample", "value")
    made = resample.affine_sample(v, ["series"], resample.hypothesis_table(spark), F.lit(31.5), F.lit(64))
    return made.groupBy("series", "hyp").agg(F.count("value").alias("n"), F.round(F.sum("value"), 5).alias("total"), F.round(F.max("value"), 6).alias("top"))


@query(f"""WITH {V1}, p AS (SELECT a.series AS a, b.series AS b, a.sample, b.value - a.value AS df FROM v1 a JOIN v1 b ON b.grp = a.grp AND b.sample = a.sample JOIN (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) n ON n.vec_id = a.series AND n.nxt = b.series),
m AS (SELECT a, b, count(*) AS overlap, quantile_cont(df, 0.5) AS off FROM p GROUP BY 1, 2), r AS (SELECT p.a, p.b, overlap, off, abs(df - off) AS r, row_number() OVER (PARTITION BY p.a, p.b ORDER BY abs(df - off)) AS k FROM p JOIN m ON m.a = p.a AND m.b = p.b)
SELECT a AS first, b AS second, any_value(overlap) AS overlap, round(any_value(off), 6) AS "offset", round(sqrt(avg(r * r)), 6) AS rmse FROM r WHERE k <= ceil(overlap * 0.99::DOUBLE) GROUP BY 1, 2""")
def alignment_metrics(spark, d):
    v = views.regular_series(spark, d)
    ids = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("first"), F.lead("vec_id").over(Window.partitionBy("label").orderBy("vec_id")).alias("second")).where("second is not null")
    a = v.select(F.col("series").alias("first"), "sample", F.col("value").alias("a"))
    b = v.select(F.col("series").alias("second"), "sample", F.col("value").alias("b"))
    pairs = a.join(ids, "first").join(b, ["second", "sample"]).withColumn("n", F.lit(64))
    return resample.alignment_metrics(pairs, ["first", "second"], F.lit(64)).select("first", "second", "overlap", F.round("offset", 6).alias("offset"), F.round("rmse", 6).alias("rmse"))


@query(f"""WITH {V2}, i AS (SELECT *, sample - row_number() OVER (PARTITION BY series ORDER BY sample) AS k FROM v2), r AS (SELECT series, min(sample) AS s, max(sample) + 1 AS e FROM i GROUP BY series, k),
t AS (SELECT series, s, e, CAST(unnest(CASE WHEN e - s = 1 THEN [CAST(floor(s * 1.5::DOUBLE + 0.5) AS BIGINT)] ELSE range(CAST(ceil(s * 1.5::DOUBLE) AS BIGINT), CAST(floor((e - 1) * 1.5::DOUBLE) AS BIGINT) + 1) END) AS BIGINT) AS target FROM r),
u AS (SELECT *, CASE WHEN e - s = 1 THEN s::DOUBLE ELSE target / 1.5::DOUBLE END AS pos FROM t), w AS (SELECT *, least(CAST(floor(pos) AS BIGINT), e - 1) AS lo FROM u)
SELECT w.series, w.target, round(CASE WHEN pos = lo THEN p.value ELSE p.value + (q.value - p.value) * (pos - lo) END, 6) AS value FROM w JOIN v2 p ON p.series = w.series AND p.sample = w.lo LEFT JOIN v2 q ON q.series = w.series AND q.sample = w.lo + 1""")
def resampled_runs(spark, d):
    return resample.resample_runs(views.gapped_series(spark, d), ["series"], 1.5).select("series", "target", F.round("value", 6).alias("value"))


@query("""WITH p AS (SELECT user_id AS series, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'), c AS (SELECT event_id, user_id AS series, epoch_us(ts) AS us FROM events WHERE event_type = 'click')
SELECT event_id, near, abs(us - near) <= 3600000000 AS within FROM (SELECT c.*, (SELECT p.us FROM p WHERE p.series = c.series ORDER BY abs(p.us - c.us), p.us LIMIT 1) AS near FROM c)""")
def nearest_peer_event(spark, d):
    e = views.read(spark, d, "events").select("event_id", F.col("user_id").alias("series"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type")
    mine, peers = e.where("event_type = 'click'").drop("event_type"), e.where("event_type = 'purchase'").select("series", "at")
    return resample.nearest(mine, peers, ["series"], "at").select("event_id", "near", (F.abs(F.col("at") - F.col("near")) <= 3_600_000_000).alias("within"))


@query(f"""WITH {V3}, c AS (SELECT series, candidate, count(*) AS n FROM v3 GROUP BY 1, 2), t AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, candidate) AS k FROM c),
v AS (SELECT v3.* FROM v3 JOIN t USING (series, candidate) WHERE k = 1), g AS (SELECT series, sample + 1 AS s, nxt AS e, nxt - sample - 1 AS len FROM (SELECT series, sample, lead(sample) OVER (PARTITION BY series ORDER BY sample) AS nxt FROM v) WHERE nxt > sample + 1 AND nxt - sample - 1 <= 3),
pe AS (SELECT v3.* FROM v3 JOIN t USING (series, candidate) WHERE k > 1), ed AS (SELECT g.*, l.value AS lv, r.value AS rv FROM g JOIN v l ON l.series = g.series AND l.sample = g.s - 1 JOIN v r ON r.series = g.series AND r.sample = g.e),
ins AS (SELECT ed.*, pe.candidate AS peer, pe.sample, pe.value FROM ed JOIN pe ON pe.series = ed.series AND pe.sample BETWEEN ed.s - 1 AND ed.e),
ok AS (SELECT series, s, peer FROM ins GROUP BY series, s, e, len, peer HAVING count(*) = len + 2 AND max(CASE WHEN sample = s - 1 THEN abs(value - lv) END) <= 500 AND max(CASE WHEN sample = e THEN abs(value - rv) END) <= 500),
f AS (SELECT series, s, sample, count(*) AS n, max(value) - min(value) AS spread, quantile_cont(value, 0.5) AS value FROM ins JOIN ok USING (series, s, peer) WHERE sample >= s AND sample < e GROUP BY 1, 2, 3),
gd AS (SELECT series, s FROM f GROUP BY 1, 2 HAVING bool_and(n >= 2 AND spread <= 500)) SELECT series, s AS "start", sample, round(value, 6) AS value FROM f JOIN gd USING (series, s)""")
def peer_gap_repair(spark, d):
    c = views.candidates(spark, d)
    n = c.groupBy("series", "candidate").agg(F.count("*").alias("n"))
    best = selection.top(n, ["series"], [F.desc("n"), F.col("candidate")]).select("series", "candidate")
    mine = c.join(best, ["series", "candidate"], "left_semi").select("series", "sample", "value")
    peers = c.join(best, ["series", "candidate"], "left_anti").withColumnRenamed("candidate", "peer")
    return selection.repaired(mine, peers, islands.gaps(mine, ["series"]), ["series"], 3, 500.0).withColumn("value", F.round("value", 6))


@query("""WITH o AS (SELECT c_nationkey AS k, CAST(floor(c_acctbal) AS INT) % 100 AS center, c_custkey FROM customer), s AS (SELECT k, center, row_number() OVER (PARTITION BY k ORDER BY c_custkey) - 1 AS r FROM o)
SELECT k, r, CASE WHEN lag(center) OVER w IS NULL THEN NULL ELSE (center + lag(center) OVER w) / 2.0::DOUBLE END AS lo, CASE WHEN lead(center) OVER w IS NULL THEN NULL ELSE (center + lead(center) OVER w) / 2.0::DOUBLE END AS hi FROM s WINDOW w AS (PARTITION BY k ORDER BY r)""")
def row_bounds(spark, d):
    w = Window.partitionBy("k").orderBy("c_custkey")
    s = views.read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), (F.floor("c_acctbal").cast("int") % 100).alias("center"), "c_custkey").withColumn("r", (F.row_number().over(w) - 1).cast("long"))
    o = Window.partitionBy("k").orderBy("r")
    return s.select("k", "r", ((F.col("center") + F.lag("center").over(o)) / 2.0).alias("lo"), ((F.col("center") + F.lead("center").over(o)) / 2.0).alias("hi"))


@query("""WITH i AS (SELECT l_orderkey AS k, least(l_quantity / 50, l_discount * 10) AS lo, greatest(l_quantity / 50, l_discount * 10) AS hi FROM lineitem), w AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM i)
SELECT k, bool_and(CASE WHEN reach IS NULL THEN lo <= 0.2 ELSE lo <= reach + 1e-12 END) AND max(hi) >= 0.8 AS covered FROM w GROUP BY 1""")
def interval_cover(spark, d):
    li = views.read(spark, d, "lineitem")
    a, b = F.col("l_quantity") / 50, F.col("l_discount") * 10
    i = li.select(F.col("l_orderkey").alias("k"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    reach = F.max("hi").over(Window.partitionBy("k").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1))
    ok = i.withColumn("reach", reach).withColumn("ok", F.when(F.col("reach").isNull(), F.col("lo") <= 0.2).otherwise(F.col("lo") <= F.col("reach") + 1e-12))
    return ok.groupBy("k").agg((F.every("ok") & (F.max("hi") >= 0.8)).alias("covered"))


# selection


@query(f"""WITH {V7}, {SCORED}, a AS (SELECT *, bool_or(kind <> 'R') OVER (PARTITION BY run) AS m FROM rk), b AS (SELECT * FROM a WHERE kind <> 'R' OR NOT m), c AS (SELECT *, bool_or(layout = 'F') OVER (PARTITION BY run) AS m2 FROM b), e AS (SELECT * FROM c WHERE layout = 'F' OR NOT m2)
SELECT run, candidate, round(rank, 4)::DOUBLE AS rank FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round(rank, 4), candidate, crop) AS k FROM e) WHERE k = 1""")
def staged_selection(spark, d):
    s = _scored(spark, d).withColumn("rank", F.round("rank", 4))
    kept = selection.staged(s, ["run"], [F.col("kind") != "R", F.col("layout") == "F"])
    return selection.top(kept, ["run"], [F.col("rank"), F.col("candidate"), F.col("crop")]).select("run", "candidate", "rank")


@query(f"""WITH {V7}, {SCORED} SELECT run, candidate, tier FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY tier, round(rank, 4), candidate, crop) AS k FROM (SELECT rk.*, CAST(CASE WHEN rk.kind = 'A' AND rk.wp < 30000 THEN 0 WHEN rk.kind = 'N' THEN 1 WHEN rk.layout = 'F' THEN 2 ELSE 3 END AS INT) AS tier FROM rk)) WHERE k = 1""")
def pooled_selection(spark, d):
    s = _scored(spark, d).withColumn("rank", F.round("rank", 4))
    return selection.pooled(s, ["run"], [(F.col("kind") == "A") & (F.col("wp") < 30000), F.col("kind") == "N", F.col("layout") == "F"], [F.col("rank"), F.col("candidate"), F.col("crop")]).select("run", "candidate", "tier")


@query(f"""WITH {V7} SELECT run, candidate, crop FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY kind = 'A' DESC, layout = 'F' DESC, warnings, missing, score DESC, crop, candidate) AS k FROM v7) WHERE k = 1""")
def seven_key_selection(spark, d):
    p = views.pools(spark, d)
    return selection.top(p, ["run"], [F.desc(F.col("kind") == "A"), F.desc(F.col("layout") == "F"), F.col("warnings"), F.col("missing"), F.desc("score"), F.col("crop"), F.col("candidate")]).select("run", "candidate", "crop")


@query(f"""WITH {V7}, g AS (SELECT run, layout, crop, max(score) AS most, min(warnings) AS least, count(*) AS size FROM v7 GROUP BY 1, 2, 3) SELECT run, layout, crop, size FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY most DESC, least, size DESC, layout, crop) AS k FROM g) WHERE k = 1""")
def largest_compatible_group(spark, d):
    return selection.largest_group(views.pools(spark, d), ["run"], ["layout", "crop"], F.col("score"), F.col("warnings")).select("run", "layout", "crop", "size")


@query(f"""WITH {V7}, {SCORED}, a AS (SELECT run, 0 AS priority, 'timing' AS source, round(rank, 4)::DOUBLE AS rank, candidate FROM rk WHERE kind = 'A' AND wp = 0), b AS (SELECT run, 1, 'verified', round(rank, 4)::DOUBLE, candidate FROM rk WHERE kind = 'N'), c AS (SELECT run, 1, 'fused', round(rank, 4)::DOUBLE + 1, candidate FROM rk WHERE layout = 'F'), e AS (SELECT run, 2, 'partial', round(rank, 4)::DOUBLE, candidate FROM rk),
u AS (SELECT *, 0 AS pl FROM a UNION ALL SELECT *, 1 FROM b UNION ALL SELECT *, 2 FROM c UNION ALL SELECT *, 3 FROM e) SELECT run, source, rank, candidate FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY priority, rank, candidate, pl) AS k FROM u) WHERE k = 1""")
def publication_decision(spark, d):
    s = _scored(spark, d).select("run", "candidate", "kind", "layout", "wp", F.round("rank", 4).alias("rank"))
    kind, rank = F.col("kind"), F.col("rank")
    sources = [(0, "timing", (kind == "A") & (F.col("wp") == 0), rank), (1, "verified", kind == "N", rank), (1, "fused", F.col("layout") == "F", rank + 1), (2, "partial", F.lit(True), rank)]
    return selection.first_source(s, ["run"], sources, ["candidate"]).select("run", "source", "rank", "candidate")


@query(f"""WITH {V7}, x AS (SELECT kind, layout, crop, avg(score) AS p FROM v7 GROUP BY 1, 2, 3 QUALIFY count(*) >= avg(count(*)) OVER ()), y AS (SELECT kind, layout, avg(score) AS p FROM v7 GROUP BY 1, 2 QUALIFY count(*) >= avg(count(*)) OVER ()), z AS (SELECT layout, avg(score) AS p FROM v7 GROUP BY 1), b AS (SELECT min(p) AS best FROM z),
j AS (SELECT v7.run, v7.candidate, v7.crop, v7.score, coalesce(x.p, y.p, z.p) AS p, CASE WHEN x.p IS NOT NULL THEN 'context' WHEN y.p IS NOT NULL THEN 'family' ELSE 'layout' END AS level FROM v7 LEFT JOIN x ON x.kind = v7.kind AND x.layout = v7.layout AND x.crop = v7.crop LEFT JOIN y ON y.kind = v7.kind AND y.layout = v7.layout LEFT JOIN z ON z.layout = v7.layout)
SELECT level, count(*) AS n, round(avg(floor(round(greatest(0, p - best) * 100, 6) + 0.5)), 6) AS penalty FROM j, b GROUP BY 1""")
def hierarchical_priors(spark, d):
    """A context or family of candidates has a prior of its own if it holds as many of them as the others on average."""
    p = views.pools(spark, d)
    held = lambda keys: p.groupBy(*keys).agg(F.avg("score").alias("prior"), F.count("*").alias("n"))
    prior = lambda keys: held(keys).crossJoin(F.broadcast(held(keys).agg(F.avg("n").alias("mean")))).where("n >= mean").select(*keys, "prior")
    context, family, layout = prior(["kind", "layout", "crop"]), prior(["kind", "layout"]), held(["layout"]).drop("n")
    found = selection.first_match(p, [("context", context, ["kind", "layout", "crop"]), ("family", family, ["kind", "layout"]), ("layout", layout, ["layout"])], "prior")
    best = layout.agg(F.min("prior").alias("best"))
    scored = found.crossJoin(F.broadcast(best)).withColumn("penalty", gates.js_round(F.round(F.greatest(F.lit(0.0), F.col("prior") - F.col("best")) * policy.PRIOR_PENALTY, 6)))
    return scored.groupBy("level").agg(F.count("*").alias("n"), F.round(F.avg("penalty"), 6).alias("penalty"))


@query(f"""WITH {V3}, c AS (SELECT series, candidate, count(*) AS n FROM v3 GROUP BY 1, 2), t AS (SELECT series, candidate FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY n DESC, candidate) AS k FROM c) WHERE k = 1) SELECT v3.series, sample, candidate, value FROM v3 JOIN t USING (series, candidate)""")
def channel_fusion(spark, d):
    c = views.candidates(spark, d)
    best = selection.top(c.groupBy("series", "candidate").agg(F.count("*").alias("n")), ["series"], [F.desc("n"), F.col("candidate")])
    return selection.fused(c, best, ["series"], "candidate").select("series", "sample", "candidate", "value")


@query("""WITH b AS (SELECT p_partkey, CAST(p_size AS DOUBLE) * 40 + 0.5 AS l, p_retailprice AS r FROM part), c AS (SELECT p_partkey, greatest(0, floor(l + 0.5)) AS x0, greatest(0, floor(10.25 + 0.5)) AS y0, least(1600, floor(r + 0.5)) AS x1, least(900, floor(l / 2 + 0.5)) AS y1 FROM b)
SELECT p_partkey, CASE WHEN x1 - x0 >= 320 AND y1 - y0 >= 160 THEN concat_ws(':', CAST(x0 AS BIGINT), CAST(y0 AS BIGINT), CAST(x1 AS BIGINT), CAST(y1 AS BIGINT)) ELSE 'full-source' END AS crop FROM c""")
def crop_keys(spark, d):
    p = views.read(spark, d, "part")
    left = F.col("p_size").cast("double") * 40 + 0.5
    box = geometry.valid_crop(left, F.lit(10.25), F.col("p_retailprice"), left / 2, F.lit(1600), F.lit(900))
    b = p.select("p_partkey", box.alias("b"))
    key = F.when(F.col("b").isNotNull(), F.concat_ws(":", *(F.col(f"b.{c}").cast("bigint").cast("string") for c in ("left", "top", "right", "bottom")))).otherwise("full-source")
    return b.select("p_partkey", key.alias("crop"))


# evidence: contracts, retention, admission, reviews


@query(f"""WITH {V2}, {GAPS}, s AS (SELECT series, "start", "end", length FROM g) SELECT series, "start", CASE WHEN p IS NULL AND "start" <> 0 THEN 'starts_late' WHEN p < "start" THEN 'hole' WHEN p > "start" THEN 'overlap' WHEN n IS NULL AND "end" <> 120 THEN 'ends_early' END AS rule FROM (SELECT *, lag("end") OVER w AS p, lead("start") OVER w AS n FROM s WINDOW w AS (PARTITION BY series ORDER BY "start", "end"))
WHERE CASE WHEN p IS NULL AND "start" <> 0 THEN 'starts_late' WHEN p < "start" THEN 'hole' WHEN p > "start" THEN 'overlap' WHEN n IS NULL AND "end" <> 120 THEN 'ends_early' END IS NOT NULL""")
def lineage_violations(spark, d):
    g = islands.gaps(views.gapped_series(spark, d), ["series"]).withColumn("n", F.lit(120))
    return islands.coverage_violations(g, ["series"], "n")


@query(f"""WITH {V3}, c AS (SELECT series, sample, string_agg(candidate, '+' ORDER BY candidate) AS op FROM v3 GROUP BY 1, 2), w AS (SELECT *, CASE WHEN sample - lag(sample) OVER o = 1 AND op = lag(op) OVER o THEN 0 ELSE 1 END AS b FROM c WINDOW o AS (PARTITION BY series ORDER BY sample)), r AS (SELECT *, sum(b) OVER (PARTITION BY series ORDER BY sample) AS k FROM w)
SELECT series, op, min(sample) AS "start", max(sample) + 1 AS "end", max(sample) + 1 - min(sample) AS length FROM r GROUP BY series, op, k""")
def interval_lineage(spark, d):
    c = views.candidates(spark, d).groupBy("series", "sample").agg(F.array_join(F.array_sort(F.collect_set("candidate")), "+").alias("op"))
    return islands.spans(c, ["series"], ["op"])


@query("""SELECT o_orderkey AS run, unnest(list_filter([CASE WHEN NOT (o_totalprice > 100000) THEN 'price' END, CASE WHEN NOT (o_orderstatus IN ('F', 'O')) THEN 'status' END, CASE WHEN NOT (o_orderpriority LIKE '%-%' AND length(o_orderpriority) < 9) THEN 'priority' END], lambda x: x IS NOT NULL)) AS rule FROM orders""")
def contract_violations(spark, d):
    o = views.read(spark, d, "orders").withColumnRenamed("o_orderkey", "run")
    return evidence.violations(o, ["run"], {"price": F.col("o_totalprice") > 100000, "status": F.col("o_orderstatus").isin("F", "O"), "priority": F.col("o_orderpriority").like("%-%") & (F.length("o_orderpriority") < 9)})


@query("""WITH a AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, count(*) AS l FROM orders GROUP BY 1), b AS (SELECT CASE WHEN l_orderkey % 5 = 0 THEN l_orderkey + 1000000000000 ELSE l_orderkey END AS k, count(*) AS r FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN l IS NULL THEN 'not_published' WHEN r IS NULL THEN 'not_described' WHEN l > 1 OR r > 1 THEN 'duplicate' END AS rule FROM a FULL JOIN b USING (k) WHERE l IS NULL OR r IS NULL OR l > 1 OR r > 1""")
def uncertainty_index(spark, d):
    changed = lambda key, step, other: F.when(key % step == 0, other).otherwise(key).alias("k")
    o = views.read(spark, d, "orders").select(changed(F.col("o_orderkey"), 3, -F.col("o_orderkey")))
    li = views.read(spark, d, "lineitem").select(changed(F.col("l_orderkey"), 5, F.col("l_orderkey") + 1_000_000_000_000))
    return evidence.matched_index(o, li, ["k"])


ASSETS = "a AS (SELECT user_id AS run, list_sort(list_distinct(list(event_type))) AS assets, list_sort(list_distinct(list(event_type) FILTER (value > 300))) AS removed FROM events GROUP BY 1)"


def _assets(spark, d):
    e = views.read(spark, d, "events")
    return e.groupBy(F.col("user_id").alias("run")).agg(F.array_sort(F.collect_set("event_type")).alias("assets"), F.array_sort(F.collect_set(F.when(F.col("value") > 300, F.col("event_type")))).alias("removed"))


@query(f"""WITH {ASSETS} SELECT run, array_to_string(list_sort(list_filter(assets, lambda x: x IN ('click', 'view'))), ',') AS retained, array_to_string(list_sort(list_filter(assets, lambda x: x NOT IN ('click', 'view'))), ',') AS newly_removed, array_to_string(list_sort(list_distinct(list_concat(coalesce(removed, []), list_filter(assets, lambda x: x NOT IN ('click', 'view'))))), ',') AS removed_total FROM a""")
def retention_sets(spark, d):
    kept = evidence.retention(_assets(spark, d), "assets", "removed", ["click", "view"])
    return kept.select("run", *(F.array_join(c, ",").alias(c) for c in ("retained", "newly_removed", "removed_total")))


@query(f"""WITH {ASSETS} SELECT run, CASE WHEN run % 10 = 0 THEN 'not_applicable' WHEN list_contains(assets, 'signup') THEN 'recorded' WHEN list_contains(coalesce(removed, []), 'signup') THEN 'unavailable_historical' ELSE 'not_recorded' END AS availability FROM a""")
def evidence_availability(spark, d):
    return _assets(spark, d).select("run", evidence.availability(F.col("assets"), F.col("removed"), "signup", F.col("run") % 10 != 0).alias("availability"))


@query("""WITH r AS (SELECT o_orderkey AS run, c_nationkey AS host, o_orderdate AS since, o_orderstatus = 'O' AS active, CAST(o_totalprice * 1000 AS BIGINT) AS size_bytes FROM orders JOIN customer ON c_custkey = o_custkey), h AS (SELECT *, CASE WHEN active THEN greatest(1073741824, size_bytes * 16) ELSE 0 END AS reserved FROM r),
u AS (SELECT *, coalesce(sum(reserved) OVER (PARTITION BY host ORDER BY since, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS in_use FROM h) SELECT run, reserved, CAST(in_use AS BIGINT) AS in_use, 400000000000 >= 5368709120 + in_use + greatest(1073741824, size_bytes * 16) AS admitted FROM u""")
def storage_admission(spark, d):
    o = views.read(spark, d, "orders").join(views.read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    runs = o.select(F.col("o_orderkey").alias("run"), F.col("c_nationkey").alias("host"), F.col("o_orderdate").alias("at"), (F.col("o_orderstatus") == "O").alias("active"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("size_bytes"))
    return evidence.admitted(runs, ["host"], F.lit(400_000_000_000), [F.col("at"), F.col("run")], F.col("active")).select("run", "reserved", "in_use", "admitted")


@query("""WITH c AS (SELECT conv_id AS run, turn, role, sha256(coalesce(text, '')) AS sha, count(*) OVER (PARTITION BY conv_id) AS event_count, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, sha256(coalesce(text, ''))) AS k FROM conversations) SELECT run, turn, event_count, sha, CASE WHEN role = 'assistant' THEN 'completed' ELSE 'needs_review' END AS status FROM c WHERE k = 1""")
def latest_review(spark, d):
    c = views.read(spark, d, "conversations").select(F.col("conv_id").alias("run"), "turn", "role", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    last = evidence.latest(c, ["run"], [F.desc("turn"), F.col("sha")])
    decision = F.when(F.col("role") == "assistant", "accepted").otherwise("rejected")
    return last.select("run", "turn", "event_count", "sha", evidence.review_status(decision, F.lit(None).cast("string")).alias("status"))


@query("""WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END AS doc_id, length(text) AS size_bytes, sha256(text) AS sha256 FROM documents), m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN length(text) + 1 ELSE length(text) END AS size_bytes, CASE WHEN doc_id % 13 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS sha256 FROM documents)
SELECT m.doc_id, CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN f.size_bytes <> m.size_bytes THEN 'size_mismatch' WHEN f.sha256 <> m.sha256 THEN 'hash_mismatch' ELSE 'verified' END AS state FROM m LEFT JOIN f USING (doc_id)""")
def verified_assets(spark, d):
    doc = views.read(spark, d, "documents").select("doc_id", "text")
    size = F.length("text")
    files = doc.select(F.expr("CASE WHEN doc_id % 11 = 0 THEN -doc_id - 1 ELSE doc_id END").alias("doc_id"), size.alias("size_bytes"), F.sha2("text", 256).alias("sha256"))
    manifest = doc.select("doc_id", F.when(F.col("doc_id") % 7 == 0, size + 1).otherwise(size).alias("size_bytes"), F.when(F.col("doc_id") % 13 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("sha256"))
    return evidence.verified(files, manifest, ["doc_id"]).select("doc_id", "state")


@query("""WITH e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE k = 1""")
def latest_gate_evaluation(spark, d):
    return selection.deduplicated(views.read(spark, d, "events"), ["user_id", "event_type"], [F.desc("event_id")]).select("user_id", "event_type", "event_id", "value")


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderkey % 9 = 0 THEN 'free' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN 'stale' WHEN o_totalprice >= 300000 THEN 'stale' ELSE 'held' END AS state FROM orders""")
def lease_states(spark, d):
    o = views.read(spark, d, "orders")
    k = F.col("o_orderkey")
    age = F.when(k % 9 != 0, F.col("o_totalprice"))
    return o.select(k.alias("run"), evidence.lease_state(age, k % 3 != 0, k % 2 == 0, 300000.0).alias("state"))


@query("""SELECT o_orderkey AS run, CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'P' THEN 'pending' ELSE 'finished' END AS processing, CASE WHEN o_totalprice > 200000 THEN 'published' ELSE 'withheld' END AS publication, CASE WHEN o_orderkey % 2 = 0 THEN 'reviewed' ELSE 'unreviewed' END AS review FROM orders""")
def outcome_dimensions(spark, d):
    o = views.read(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "running").otherwise("done")
    return o.select(F.col("o_orderkey").alias("run"), evidence.outcome(status, F.col("o_totalprice") > 200000, F.col("o_orderkey") % 2 == 0).alias("o")).select("run", "o.*")


# scalar functions


@query(r"""SELECT page_id, CASE WHEN regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') = '' THEN 'signal' ELSE regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') END AS stem, left(trim(regexp_replace(regexp_replace(url, '[<>:"/\\|?*]', '-', 'g'), '\s+', ' ', 'g')), 160) AS file_name, sha256('page:' || page_id || ':' || url) AS ident FROM pages""")
def names_and_identities(spark, d):
    p = views.read(spark, d, "pages")
    return p.select("page_id", text.safe_stem(F.col("url")).alias("stem"), text.clean_file_name(F.col("url")).alias("file_name"), text.identity(F.lit("page"), F.col("page_id"), F.col("url")).alias("ident"))


@query("""WITH m AS (SELECT s_suppkey, 1 + s_suppkey / 1000.0::DOUBLE AS a, s_suppkey / 500.0::DOUBLE AS b, s_suppkey % 7 / 10000.0::DOUBLE AS g FROM supplier), p AS (SELECT s_suppkey, (a * 3 + b * 4 + 5) / (g * 3 + 1) AS x, (2 * 4 + 6) / (g * 3 + 1) AS y FROM m) SELECT s_suppkey, round(x, 6)::DOUBLE AS x, round(y, 6)::DOUBLE AS y, 3.0::DOUBLE AS back_x, 4.0::DOUBLE AS back_y, TRUE AS ok FROM p""")
def homography(spark, d):
    k = F.col("s_suppkey").cast("double")
    m = geometry.matrix(1 + k / 1000, k / 500, F.lit(5), F.lit(0), F.lit(2), F.lit(6), k.cast("long") % 7 / F.lit(10000.0), F.lit(0), F.lit(1))
    s = views.read(spark, d, "supplier").select("s_suppkey", m.alias("m")).withColumn("p", geometry.project(F.col("m"), F.lit(3.0), F.lit(4.0))).withColumn("q", geometry.project(geometry.inverse(F.col("m")), F.col("p.x"), F.col("p.y")))
    return s.select("s_suppkey", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("q.x", 6).alias("back_x"), F.round("q.y", 6).alias("back_y"), geometry.invertible(F.col("m")).alias("ok"))


@query("""SELECT l_orderkey, l_linenumber, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_orderkey, CASE WHEN l_quantity < 2 THEN 0 ELSE l_linenumber END AS l_linenumber, 1 AS n FROM lineitem UNION ALL SELECT o_orderkey, CASE WHEN o_totalprice > 400000 THEN 0 ELSE 1 END, 1 FROM orders UNION ALL SELECT o_orderkey, 0, 1 FROM orders) GROUP BY 1, 2""")
def candidate_pool_union(spark, d):
    li, o = views.read(spark, d, "lineitem"), views.read(spark, d, "orders")
    line = F.when(F.col("l_quantity") < 2, 0).otherwise(F.col("l_linenumber"))
    parts = [li.select("l_orderkey", line.alias("l_linenumber")), o.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_totalprice") > 400000, 0).otherwise(1).alias("l_linenumber")), o.select(F.col("o_orderkey").alias("l_orderkey"))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2], allowMissingColumns=True)
    return every.groupBy("l_orderkey", F.coalesce("l_linenumber", F.lit(0)).alias("l_linenumber")).agg(F.count("*").alias("n"))
