"""Queries on captures: preparation, planning, components, rays, grid lines, profiles, tokens and confirmations, with oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import capture
from lacuna.operators import trust
from lacuna.queries import query
from lacuna.queries_trust import ALL, LEADS
from lacuna.sources import trust_views, views


def _parts(spark, d):
    p, k = views.read(spark, d, "part"), F.col("p_partkey")
    return p.select(k, (k % 1700 + 300).cast("int").alias("w"), (F.col("p_size") * 30).cast("int").alias("h"), (k % 400).cast("double").alias("sharp"), (k % 101 / F.lit(100.0)).alias("trace"), (k % 83 / F.lit(83.0)).alias("grid"))


PARTS = "pt AS (SELECT p_partkey, CAST(300 + p_partkey % 1700 AS INT) AS w, CAST(p_size * 30 AS INT) AS h, (p_partkey % 400)::DOUBLE AS sharp, p_partkey % 101 / 100.0::DOUBLE AS trace, p_partkey % 83 / 83.0::DOUBLE AS grid FROM part)"


@query(f"""WITH {PARTS}, b AS (SELECT *, sharp < 200 AS blur, greatest(w, h) < 1200 AS low, trace >= 0.35 AND grid <= 0.5 AS deg, sharp < 200 AND trace >= 0.9 AND grid <= 0.4 AS smooth FROM pt)
SELECT p_partkey, NOT (blur AND NOT smooth) AND (low OR deg) AS eligible, CASE WHEN NOT (blur OR smooth OR low OR deg) THEN 'clean-or-unsupported' ELSE concat_ws(',', CASE WHEN blur AND NOT smooth THEN 'blur-rejected' END, CASE WHEN smooth THEN 'trace-dominant-smooth-source' END, CASE WHEN low THEN 'low-resolution' END, CASE WHEN deg THEN 'foreground-grid-degraded' END) END AS reasons FROM b""")
def preparation_classes(spark, d):
    c = F.col
    return _parts(spark, d).select("p_partkey", capture.preparation(F.greatest("w", "h"), c("sharp"), c("trace"), c("grid")).alias("p")).select("p_partkey", "p.eligible", F.array_join("p.reasons", ",").alias("reasons"))


@query(f"""WITH {PARTS} SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'geometry-corrected' WHEN p_partkey % 3 > 0 THEN 'annotation-masked' ELSE 'original' END AS variant, CASE WHEN greatest(w, h) <= 600 THEN 1200 ELSE 0 END AS upscale,
CASE WHEN p_partkey % 4 = 0 AND trace >= 0.5 AND grid >= 0.6 THEN 'standard_3x4' WHEN p_partkey % 4 = 1 AND (trace >= 0.5 OR p_partkey % 7 = 0) AND grid >= 0.5 THEN 'standard_6x2' ELSE 'none' END AS plain FROM pt""")
def planning_contexts(spark, d):
    c, k = F.col, F.col("p_partkey")
    layout = F.when(k % 4 == 0, "standard_3x4").when(k % 4 == 1, "standard_6x2")
    plain = capture.plain_layout(layout, c("trace") >= 0.5, F.when(k % 7 == 0, "standard_6x2"), c("grid"))
    return _parts(spark, d).select(k, capture.input_variant(F.when(k % 5 == 0, "geometry-corrected").otherwise("original"), k % 3).alias("variant"), F.coalesce(capture.upscale_target(c("w"), c("h")), F.lit(0)).alias("upscale"), F.coalesce(plain, F.lit("none")).alias("plain"))


@query(f"""WITH {PARTS} SELECT p_partkey, CAST(least(w, greatest(0, round_even((p_partkey % 900 - 20) / (0.5::DOUBLE + p_partkey % 3), 0))) AS INT) AS x0, CAST(least(h, greatest(0, round_even((p_partkey % 700 + 5) / 1.5::DOUBLE, 0))) AS INT) AS y1 FROM pt""")
def source_components(spark, d):
    k = F.col("p_partkey")
    return _parts(spark, d).select(k, capture.in_source(k % 900 - 20, k % 3 + F.lit(0.5), F.col("w")).alias("x0"), capture.in_source(k % 700 + 5, F.lit(1.5), F.col("h")).alias("y1"))


@query(f"""WITH {PARTS}, t AS (SELECT p_partkey, unnest(range(5)) AS i, w, h FROM pt), q AS (SELECT p_partkey, i, CASE WHEN abs(-9000.0::DOUBLE - 0.5::DOUBLE * (i * h / 4.0::DOUBLE)) > 1e-12 THEN w + i * 0.25::DOUBLE + (h - i * h / 4.0::DOUBLE) * (700.0::DOUBLE - 0.5::DOUBLE * (w + i * 0.25::DOUBLE)) / (-9000.0::DOUBLE - 0.5::DOUBLE * (i * h / 4.0::DOUBLE)) END AS px FROM t),
m AS (SELECT p_partkey, median(px) AS mid FROM q GROUP BY 1) SELECT p_partkey, round(any_value(mid), 6) AS reference_x, round(max(abs(px - mid)), 6) AS worst, round(max(px) - min(px), 6) AS "range", max(abs(px - mid)) <= 1.0 AS constant FROM q JOIN m USING (p_partkey) GROUP BY 1""")
def ray_residuals(spark, d):
    c = F.col
    points = _parts(spark, d).select("p_partkey", "w", "h", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    vanishing = F.struct(F.lit(700.0).alias("x"), F.lit(-9000.0).alias("y"), F.lit(0.5).alias("w"))
    placed = points.select("p_partkey", capture.project_x(vanishing, c("w") + c("i") * 0.25, c("i") * c("h") / 4.0, c("h")).alias("px"))
    middle = placed.groupBy("p_partkey").agg(F.percentile("px", F.lit(0.5)).alias("mid"), F.collect_list("px").alias("all"))  # a track has few points
    worst = F.array_max(F.transform("all", lambda x: F.abs(x - c("mid"))))
    return middle.select("p_partkey", F.round("mid", 6).alias("reference_x"), F.round(worst, 6).alias("worst"), F.round(F.array_max("all") - F.array_min("all"), 6).alias("range"), (worst <= 1.0).alias("constant"))


@query(f"""WITH {PARTS}, g AS (SELECT p_partkey, w::DOUBLE AS x, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE h::DOUBLE END AS up, h + (p_partkey % 5) * 40 + p_partkey % 7 - 3.0::DOUBLE AS low, p_partkey % 6 AS steps FROM pt)
SELECT p_partkey, CASE WHEN up IS NULL THEN 'missing-paired-observation' WHEN NOT (x >= 400 AND x < 1800 AND (up + low) / 2 >= 50 AND (up + low) / 2 < 1400) THEN 'outside-model-domain' ELSE 'measured' END AS status, coalesce(x >= 400 AND x < 1800 AND (up + low) / 2 >= 50 AND (up + low) / 2 < 1400 AND steps BETWEEN 1 AND 4 AND round_even((low - up) / 40, 0) = steps AND abs(low - up - steps * 40) <= 2, FALSE) AS passed FROM g""")
def paired_grid_lines(spark, d):
    k, h = F.col("p_partkey"), F.col("h").cast("double")
    domain = F.struct(F.lit(400.0).alias("x0"), F.lit(1800.0).alias("x1"), F.lit(50.0).alias("y0"), F.lit(1400.0).alias("y1"))
    made = capture.paired_lines(F.col("w").cast("double"), F.when(k % 11 != 0, h), h + k % 5 * 40 + k % 7 - 3.0, k % 6, F.lit(40.0), domain)
    return _parts(spark, d).select(k, made.alias("m")).select("p_partkey", "m.status", "m.passed")


@query(f"""WITH {PARTS} SELECT p_partkey, CASE WHEN p_partkey % 13 = 0 THEN 'incompatible' WHEN p_partkey % 4 = 0 THEN 'historical_unverified' WHEN p_partkey % 3 > 0 AND p_partkey % 5 < 2 THEN 'compatible' ELSE 'incompatible' END AS profile, p_partkey % 2 = 0 AND p_partkey % 3 = 0 AND p_partkey % 5 > 0 AS keeps FROM pt""")
def profile_gates(spark, d):
    k = F.col("p_partkey")
    profile = capture.profile_compatibility(F.when(k % 13 == 0, 5.0).when(k % 2 == 0, 10.0), k % 4 != 0, k % 3 > 0, F.array(F.lit("0"), F.lit("1")), (k % 5).cast("string"))
    keeps = capture.keeps_source_geometry(F.when(k % 2 == 0, "original"), k % 3 == 0, F.lit(True), F.when(k % 5 == 0, "calibration_conflict"), F.lit("geometry-corrected"), F.lit("geometry-corrected"))
    return _parts(spark, d).select(k, profile.alias("profile"), keeps.alias("keeps"))


@query("""WITH a AS (SELECT o_orderkey AS page, l_linenumber % 4 AS slot, l_partkey AS seq, 'a' || l_suppkey AS token, 0 AS tier FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, l_linenumber % 4, l_partkey, 'b' || l_suppkey, 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag <> 'R')
SELECT page, slot, row_number() OVER (PARTITION BY page, slot ORDER BY tier, seq, token) - 1 AS place, token FROM a""")
def merged_tokens(spark, d):
    li = views.read(spark, d, "lineitem").join(views.read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey")
    seen = lambda mark, rule: li.where(rule).select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 4).alias("slot"), F.col("l_partkey").alias("seq"), F.concat(F.lit(mark), "l_suppkey").alias("token"))
    return trust.merged_tokens(seen("a", F.col("l_returnflag") == "R"), seen("b", F.col("l_returnflag") != "R"), ["page"])


@query(f"""{ALL}, {LEADS}, dp AS (SELECT run, a AS id, b AS peer, lead, rmse FROM prs UNION ALL SELECT run, b, a, lead, rmse FROM prs), sel AS (SELECT run, min(id) AS id FROM g WHERE canonical GROUP BY 1),
src AS (SELECT run, id, (h % 50)::DOUBLE AS rk FROM g WHERE status = 'completed' AND NOT native AND NOT derived AND NOT permissive AND canonical AND why IS NULL),
dec AS (SELECT run, max(id) AS id, run % 12 AS lead FROM g GROUP BY 1),
u AS (SELECT run, lead, id, 0 AS tier, 0.0::DOUBLE AS rk FROM dec JOIN src USING (run, id) UNION ALL SELECT le.run, le.lead, le.id, 1, 0.0::DOUBLE FROM le JOIN sel USING (run, id) JOIN src USING (run, id) WHERE complete
UNION ALL SELECT dp.run, dp.lead, dp.peer, 2, src.rk FROM dp JOIN sel USING (run, id) JOIN src ON src.run = dp.run AND src.id = dp.peer JOIN le ON le.run = dp.run AND le.id = dp.peer AND le.lead = dp.lead WHERE rmse <= 75 AND le.complete)
SELECT run, lead, id AS source FROM (SELECT *, row_number() OVER (PARTITION BY run, lead ORDER BY tier, rk, id) AS k FROM u) WHERE k = 1""")
def confirmation_sources(spark, d):
    c, leads, pairs = trust_views.tables(spark, d)
    known, held = trust.facts(c), trust.lead_facts(c, leads)
    selected = known.where("canonical").groupBy("run").agg(F.min("id").alias("id"))
    able = known.where("status = 'completed' and not native and not derived and not permissive and canonical and ineligible is null").select("run", "id")
    sources = able.join(c.select("run", "id", (F.col("h") % 50).cast("double").alias("rank")), ["run", "id"])
    declared = known.groupBy("run").agg(F.max("id").alias("id")).withColumn("lead", F.col("run") % 12)
    return trust.confirmation_sources(selected, sources, held, pairs, declared)
