"""Queries on paper coordinates and on uncorroborated excursions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import excursions, fields
from lacuna.queries import V1, query
from lacuna.queries_curves import _DOMAIN, _intervals
from lacuna.sources import views

# Nations are pages with trapezoid cells, one of twelve missing; customers are paths of thirty columns over them.
_POINT = "CAST(id % 85 + i AS DOUBLE) + CASE WHEN id % 2 = 0 THEN 0.5 ELSE 0 END AS x, 3.0D + (id * 7 + i * 3) % 14 + (id % 3) / 4.0D AS y, (id + i) % 11 <> 0 AS valid"
_RATE = 120
_MESH = f"""dm AS (SELECT page, k AS cell, {_DOMAIN.replace('D *', '::DOUBLE *').replace('D +', '::DOUBLE +').replace('AS left', 'AS x0').replace('AS right', 'AS x1')} FROM (SELECT n_nationkey AS page, unnest(range(12)) AS k FROM nation) WHERE k <> page % 12),
pt AS (SELECT page, id, i, {_POINT.replace('3.0D', '3.0::DOUBLE').replace('4.0D', '4.0::DOUBLE')} FROM (SELECT c_nationkey AS page, c_custkey AS id, unnest(range(30)) AS i FROM customer)),
pe AS (SELECT pt.*, cell, u0 * (1 - (x - x0) / (x1 - x0)) + u1 * ((x - x0) / (x1 - x0)) AS top, v0 * (1 - (x - x0) / (x1 - x0)) + v1 * ((x - x0) / (x1 - x0)) AS bottom FROM pt JOIN dm ON dm.page = pt.page AND x BETWEEN x0 AND x1),
fw AS (SELECT page, id, i, min(cell) AS cell, count(*) AS n_cells, arg_min((y - top) / (bottom - top) * 5, cell) AS mm FROM pe WHERE y BETWEEN top AND bottom GROUP BY 1, 2, 3)"""


def _field(spark, d):
    cells = views.read(spark, d, "nation").selectExpr("n_nationkey AS page", "explode(sequence(0, 11)) AS k").where("k <> page % 12").selectExpr("page", "CAST(k AS BIGINT) AS cell", *_DOMAIN.replace("AS left", "AS x0").replace("AS right", "AS x1").split(", "), "0D AS mm0", "5D AS mm1")
    points = views.read(spark, d, "customer").selectExpr("c_nationkey AS page", "c_custkey AS id", "explode(sequence(0, 29)) AS i").selectExpr("page", "id", "i", *_POINT.split(", "))
    return points, cells


@query(f"""WITH {_MESH} SELECT pt.page, pt.id, CAST(pt.i AS INT) AS i, cell, coalesce(n_cells, 0) AS n_cells, round(mm, 8) AS mm, CASE WHEN mm IS NOT NULL THEN round(y, 8) END AS y_again FROM pt LEFT JOIN fw ON fw.page = pt.page AND fw.id = pt.id AND fw.i = pt.i""")
def paper_places(spark, d):
    """Points in millimetres, and their y found again from these."""
    points, cells = _field(spark, d)
    keyed = points.withColumn("i", F.struct("id", "i"))
    there = fields.to_paper(keyed, cells, ["page"], 10.0)
    back = fields.to_source(there.select("page", "i", "x", "mm", F.col("cell").alias("own"), F.col("n_cells").alias("n_own")), cells, ["page"], 10.0)
    return back.select("page", "i.id", "i.i", F.col("own").alias("cell"), F.col("n_own").alias("n_cells"), F.round("mm", 8).alias("mm"), F.round("y", 8).alias("y_again"))


@query(f"""WITH {_MESH}, sl AS (SELECT *, (u1 - u0) / (x1 - x0) AS us, (v1 - v0) / (x1 - x0) AS vs FROM dm),
ms AS (SELECT page, cell, unnest([{{'ax': 1.0::DOUBLE, 'ay': 0.0::DOUBLE, 'k': -x0}}, {{'ax': -1.0, 'ay': 0.0, 'k': x1}}, {{'ax': -us, 'ay': 1.0, 'k': us * x0 - u0}}, {{'ax': vs, 'ay': -1.0, 'k': v0 - vs * x0}}], recursive := true) FROM sl),
ok AS (SELECT pt.page, pt.id, pt.i, x, y, x / 50 AS t, mm FROM pt JOIN fw ON fw.page = pt.page AND fw.id = pt.id AND fw.i = pt.i WHERE valid),
bs AS (SELECT page, id, median(mm) AS m FROM ok GROUP BY 1, 2), nx AS (SELECT ok.*, (m - mm) / 10 AS mv, lead(i) OVER w AS i2, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(x / 50) OVER w AS t2, lead((m - mm) / 10) OVER w AS mv2 FROM ok JOIN bs USING (page, id) WINDOW w AS (PARTITION BY page, id ORDER BY i)),
cd AS (SELECT * FROM nx WHERE i2 = i + 1), mg AS (SELECT page, id, i, cell, 0.0::DOUBLE AS a, ax * (x2 - x) + ay * (y2 - y) AS b, ax * x + ay * y + k AS c FROM cd JOIN ms USING (page)), {_intervals("mg", "page, id, i, cell")},
rn AS (SELECT page, id, i, lo, hi, coalesce(max(hi) OVER (PARTITION BY page, id, i ORDER BY lo, hi, cell ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM iv),
jn AS (SELECT cd.* FROM cd SEMI JOIN (SELECT page, id, i FROM rn GROUP BY 1, 2, 3 HAVING bool_and(lo <= before + 1e-12) AND max(hi) >= 1 - 1e-12) j ON j.page = cd.page AND j.id = cd.id AND j.i = cd.i),
tg AS (SELECT page, id, t, t2, mv, mv2, unnest(range(CAST(ceil(t * {_RATE}) AS BIGINT), CAST(floor(t2 * {_RATE}) AS BIGINT) + 1)) AS target FROM jn)
SELECT page, id, target, round(any_value(mv + (mv2 - mv) * ((target / {_RATE} - t) / (t2 - t))), 7) AS mv FROM tg WHERE target / {_RATE} BETWEEN t AND t2 GROUP BY 1, 2, 3""")
def paper_signals(spark, d):
    points, cells = _field(spark, d)
    paths = points.withColumnRenamed("id", "path").withColumn("time", F.col("x") / 50)
    samples = fields.converted(paths, cells, ["page"], 10.0, 10.0, _RATE)[1]
    return samples.select("page", F.col("path").alias("id"), "target", F.round("mv", 7).alias("mv"))


# An embedding is a path, four of them a page; a third of them has a spike at its event.
_Y = "value * 0.3D + CASE WHEN sample = 20 + series % 20 AND series % 3 = 0 THEN 10.0D + series % 9 ELSE 0 END"
_VALID = "(series * 5 + sample) % 61 <> 0 OR series % 4 = 1"
_EVENT = "(20 + series % 20) / 100.0D AS time, (20 + series % 20) / 100.0D + 0.001D AS extreme_time, 40.0D AS pulse, series % 7 = 0 AS paired"
_D = lambda e: e.replace("0.3D", "0.3::DOUBLE").replace("10.0D", "10.0::DOUBLE").replace("100.0D", "100.0::DOUBLE").replace("0.001D", "0.001::DOUBLE").replace("40.0D", "40.0::DOUBLE")


@query(f"""WITH {V1}, po AS (SELECT series // 4 AS page, series, sample AS i, sample / 100.0::DOUBLE AS t, {_D(_Y)} AS y, {_VALID} AS valid FROM v1), ev AS (SELECT series // 4 AS page, series, {_D(_EVENT)} FROM (SELECT DISTINCT series FROM v1)),
pw AS (SELECT ev.*, i, t, y, valid, t - time AS d FROM ev JOIN po USING (page, series)),
bl AS (SELECT series, lft, CASE WHEN isfinite(quantile_cont(lo, 0.5)) THEN quantile_cont(lo, 0.5) END AS lower, CASE WHEN isfinite(quantile_cont(hi, 0.5)) THEN quantile_cont(hi, 0.5) END AS upper, count(*) FILTER (valid) AS known FROM (SELECT series, d < 0 AS lft, valid, CASE WHEN valid THEN y ELSE -1e300 END AS lo, CASE WHEN valid THEN y ELSE 1e300 END AS hi FROM pw WHERE d BETWEEN -0.12 AND -0.08 OR d BETWEEN 0.08 AND 0.12) GROUP BY 1, 2),
bd AS (SELECT series, min(lower) AS low, max(upper) AS high FROM bl GROUP BY 1 HAVING count(*) = 2 AND bool_and(known >= 2 AND abs(lower) < 1e200 AND abs(upper) < 1e200)),
tp AS (SELECT series, arg_min(i, (abs(t - extreme_time), i)) AS ti, arg_min(t, (abs(t - extreme_time), i)) AS tt, arg_min(y, (abs(t - extreme_time), i)) AS ty FROM pw GROUP BY 1),
am AS (SELECT tp.*, low, high, greatest(low - ty, ty - high, 0) AS amplitude, greatest(2, greatest(low - ty, ty - high, 0) * 0.1) AS band FROM tp LEFT JOIN bd USING (series)),
bk AS (SELECT series, max(i) FILTER (i < ti) AS bi, arg_max(t, i) FILTER (i < ti) AS bt, min(i) FILTER (i > ti) AS ai, arg_min(t, i) FILTER (i > ti) AS aft FROM pw JOIN am USING (series) WHERE valid AND abs(t - tt) <= 0.04 AND greatest(abs(y - low), abs(y - high)) <= band GROUP BY 1),
sp AS (SELECT series, bool_and(valid) AS whole FROM pw JOIN bk USING (series) WHERE i BETWEEN bi AND ai GROUP BY 1), co AS (SELECT series, bool_and(valid) AS core FROM pw WHERE abs(d) <= 0.04 GROUP BY 1),
pr AS (SELECT series, count(*) = 3 AND bool_and(n >= 2 AND share >= 0.9) AS seen FROM (SELECT ev.series, po.series AS peer, count(*) AS n, avg(po.valid::INT) AS share FROM ev JOIN po ON po.page = ev.page AND po.series <> ev.series WHERE abs(po.t - time) <= 0.04 GROUP BY 1, 2) GROUP BY 1),
ck AS (SELECT ev.page, series, ti, CASE WHEN low IS NOT NULL THEN amplitude END AS amplitude, CASE WHEN bi IS NOT NULL AND ai IS NOT NULL THEN aft - bt END AS width, bi, ai, list_filter([CASE WHEN low IS NULL THEN 'bounded' END, CASE WHEN NOT coalesce(high - low <= band, FALSE) THEN 'flanks_agree' END, CASE WHEN NOT coalesce(low IS NOT NULL AND amplitude >= pulse * 0.3, FALSE) THEN 'high_enough' END, CASE WHEN bi IS NULL OR ai IS NULL THEN 'returns' END, CASE WHEN NOT coalesce(aft - bt <= 0.04, FALSE) THEN 'narrow' END, CASE WHEN NOT coalesce(whole, FALSE) THEN 'whole' END, CASE WHEN NOT coalesce(core, FALSE) THEN 'core_valid' END, CASE WHEN NOT coalesce(seen, FALSE) THEN 'peers_seen' END, CASE WHEN paired THEN 'alone' END], lambda f: f IS NOT NULL) AS failed FROM ev JOIN am USING (series) LEFT JOIN bk USING (series) LEFT JOIN sp USING (series) LEFT JOIN co USING (series) LEFT JOIN pr USING (series))
SELECT page, series AS path, ti AS extreme, round(amplitude, 8) AS amplitude, round(width, 8) AS width, array_to_string(failed, ',') AS failed, len(failed) = 0 AS rejected, CASE WHEN len(failed) = 0 THEN bi END AS gap_start, CASE WHEN len(failed) = 0 THEN ai + 1 END AS gap_end FROM ck""")
def narrow_excursions(spark, d):
    v = views.regular_series(spark, d)
    page = F.floor(F.col("series") / 4).alias("page")
    points = v.select(page, F.col("series").alias("path"), F.col("sample").alias("i"), (F.col("sample") / F.lit(100.0)).alias("time"), F.expr(_Y).alias("y"), F.expr(_VALID).alias("valid"))
    own = views.read(spark, d, "embeddings").selectExpr("vec_id AS series").distinct().select(page, "series")
    mates = own.groupBy("page").agg(F.collect_list("series").alias("all"))
    events = own.join(mates, "page").selectExpr("page", "series AS path", "0 AS event", *_EVENT.split(", "), "array_except(all, array(series)) AS peers")
    found = excursions.classify(events, points, ["page"])
    return found.select("page", "path", "extreme", F.round("amplitude", 8).alias("amplitude"), F.round("width", 8).alias("width"), F.array_join("failed", ",").alias("failed"), "rejected", "gap_start", "gap_end")
