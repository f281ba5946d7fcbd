"""Queries on paper, paths and composed pages, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import geometry, paper
from lacuna.operators import grouped, paths
from lacuna.queries import V1, query
from lacuna.sources import views

# calibration

CAL = "c AS (SELECT l_orderkey AS run, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, CASE WHEN l_quantity > 25 THEN 50.0 ELSE 25.0 END::DOUBLE AS speed, CASE WHEN l_linenumber % 3 = 0 THEN 5 WHEN l_linenumber % 3 = 1 THEN 10 ELSE 20 END::DOUBLE AS gain, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN 50 WHEN l_partkey % 5 = 2 THEN 12.5 ELSE 25 END::DOUBLE AS printed, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE 10 END::DOUBLE AS printed_gain, l_returnflag = 'R' AS conflict, l_linestatus = 'F' AS detected, 2.0::DOUBLE + l_partkey % 10 AS x, 2.0::DOUBLE + l_partkey % 10 + (l_suppkey % 3) / 10.0::DOUBLE AS y, (l_partkey % 40 + l_suppkey % 3)::DOUBLE AS period, CASE WHEN l_suppkey % 3 = 0 THEN 1 WHEN l_suppkey % 3 = 1 THEN 5 ELSE 2 END::DOUBLE AS scale_mm FROM lineitem)"


def _calibrations(spark, d):
    li = views.read(spark, d, "lineitem")
    c, cast = F.col, lambda e: e.cast("double")
    part, supp = c("l_partkey"), c("l_suppkey")
    x = part % 10 + F.lit(2.0)
    return li.select(
        c("l_orderkey").alias("run"), c("l_linenumber").alias("line"), part.alias("part"), supp.alias("supp"), F.when(c("l_quantity") > 25, 50.0).otherwise(25.0).alias("speed"), cast(F.when(c("l_linenumber") % 3 == 0, 5).when(c("l_linenumber") % 3 == 1, 10).otherwise(20)).alias("gain"),
        F.when(part % 5 == 0, None).when(part % 5 == 1, 50.0).when(part % 5 == 2, 12.5).otherwise(25.0).alias("printed"), F.when(supp % 4 > 0, 10.0).alias("printed_gain"), (c("l_returnflag") == "R").alias("conflict"), (c("l_linestatus") == "F").alias("detected"),
        x.alias("x"), (x + supp % 3 / F.lit(10.0)).alias("y"), cast(part % 40 + supp % 3).alias("period"), cast(F.when(supp % 3 == 0, 1).when(supp % 3 == 1, 5).otherwise(2)).alias("scale_mm"),
    )


@query(f"""WITH {CAL} SELECT run, line, part, supp, CASE WHEN (printed IS NOT NULL AND printed NOT IN (25, 50)) OR (printed_gain IS NOT NULL AND printed_gain NOT IN (5, 10, 20)) THEN 'unsupported' WHEN conflict OR (detected AND (coalesce(abs(printed - speed) > 0.01 * greatest(printed, speed), FALSE) OR coalesce(abs(printed_gain - gain) > 0.01 * greatest(printed_gain, gain), FALSE))) THEN 'conflict' WHEN detected AND (printed IS NOT NULL OR printed_gain IS NOT NULL) THEN 'confirmed' ELSE 'not_compared' END AS state FROM c""")
def printed_settings(spark, d):
    c = F.col
    return _calibrations(spark, d).select("run", "line", "part", "supp", paper.settings_state(c("detected"), c("speed"), c("gain"), c("printed"), c("printed_gain"), c("conflict")).alias("state"))


@query(f"""WITH {CAL}, r AS (SELECT *, list_transform(range(CASE WHEN part % 3 = 0 THEN 6 WHEN part % 3 = 1 THEN 12 ELSE 4 END), lambda i: x + (i * supp) % 3 / 100.0::DOUBLE) AS rs, 4.0::DOUBLE + part % 4 / 2.0::DOUBLE AS pulse FROM c),
s AS (SELECT *, (list_max(rs) - list_min(rs)) / list_median(rs) AS spread FROM r)
SELECT run, line, part, supp, CASE WHEN len(rs) IN (6, 12) THEN round(spread, 9) END AS spread, coalesce(speed = 25 AND printed = 50 AND printed_gain = gain AND abs(x - y) / greatest(x, y) <= 0.05 AND len(rs) IN (6, 12) AND spread <= 0.02 AND list_max(rs) <= 40 AND pulse BETWEEN 4.5 AND 5.5, FALSE) AS resolved FROM s""")
def printed_speed_resolution(spark, d):
    c = F.col
    rows = F.transform(F.sequence(F.lit(0), F.when(c("part") % 3 == 0, 5).when(c("part") % 3 == 1, 11).otherwise(3)), lambda i: c("x") + (i * c("supp")) % 3 / F.lit(100.0))
    held = _calibrations(spark, d).withColumn("rs", rows).withColumn("pulse", c("part") % 4 / F.lit(2.0) + 4.0)
    return held.select("run", "line", "part", "supp", F.round(paper.row_spread(c("rs")), 9).alias("spread"), paper.speed_resolved(c("speed"), c("printed"), c("gain"), c("printed_gain"), F.lit(0.5), c("rs"), c("x"), c("y"), c("pulse")).alias("resolved"))


@query(f"""WITH {CAL}, t AS (SELECT *, CASE WHEN period > 0 AND scale_mm IN (1, 5) THEN period / scale_mm END AS raw, list_transform(range(5 + line % 2), lambda i: x + i / 8.0::DOUBLE) AS rs FROM c)
SELECT run, line, part, supp, raw AS pixels_per_mm, CASE WHEN conflict THEN CASE WHEN len(rs) = 6 THEN list_min(rs) ELSE y END WHEN raw BETWEEN 1 AND 40 THEN raw ELSE y END AS timing_scale FROM t""")
def timing_scales(spark, d):
    c = F.col
    rows = F.transform(F.sequence(F.lit(0), 4 + c("line") % 2), lambda i: c("x") + i / F.lit(8.0))
    return _calibrations(spark, d).select("run", "line", "part", "supp", paper.pixels_per_mm(c("period"), c("scale_mm")).alias("pixels_per_mm"), paper.timing_scale(rows, c("y"), c("period"), c("scale_mm"), ~c("conflict")).alias("timing_scale"))


@query(f"""WITH {CAL} SELECT run, line, part, supp, detected AND part % 100 / 100.0::DOUBLE >= 0.35 AND scale_mm IN (1, 5) AND line <> 4 AND supp % 20 / 100.0::DOUBLE <= 0.12 AND abs(x + 0.5::DOUBLE - x) / x <= 0.12 AND abs(x + 0.5::DOUBLE - y) / y <= 0.12 AND part % 9 > supp % 5 AS confirmed,
conflict AND coalesce(printed <> 12.5, TRUE) AND (detected OR printed_gain IS NOT NULL) AS fallback FROM c""")
def source_timing_gates(spark, d):
    c = F.col
    sure = paper.confirms_source_timing(c("detected"), c("part") % 100 / F.lit(100.0), c("scale_mm"), F.when(c("line") != 4, c("scale_mm")).otherwise(9.0), c("supp") % 20 / F.lit(100.0), c("x"), c("y"), c("x") + 0.5, c("speed"), c("gain"), c("supp") % 5, c("part") % 9)
    back = paper.global_fallback(F.when(~c("conflict"), 1), c("printed") != 12.5, c("detected"), c("printed_gain"))
    return _calibrations(spark, d).select("run", "line", "part", "supp", sure.alias("confirmed"), back.alias("fallback"))


# pages


@query("""SELECT p_partkey, c, CAST(CASE WHEN p_size % 2 = 0 THEN greatest(3, round_even(w * CASE WHEN c = 1 THEN 0.082::DOUBLE ELSE 0.041::DOUBLE END, 0)) ELSE CASE WHEN c = 0 THEN greatest(3, round_even(w * 0.045::DOUBLE, 0)) ELSE 0 END END AS INT) AS "start", CAST(CASE WHEN p_size % 2 = 0 THEN greatest(2, round_even(w * 0.008::DOUBLE, 0)) ELSE CASE WHEN c = 3 THEN greatest(2, round_even(w * 0.014::DOUBLE, 0)) ELSE 0 END END AS INT) AS "end"
FROM (SELECT p_partkey, p_size, CAST(200 + p_partkey % 700 AS INT) AS w, unnest(range(CASE WHEN p_size % 2 = 0 THEN 2 ELSE 4 END)) AS c FROM part)""")
def panel_margins(spark, d):
    p = views.read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 700 + 200).cast("int").alias("w"), F.when(F.col("p_size") % 2 == 0, 2).otherwise(4).alias("n"))
    each = p.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return each.select("p_partkey", F.col("c").cast("long").alias("c"), paper.panel_margins(F.col("w"), F.col("c"), F.col("n")).alias("m")).select("p_partkey", "c", "m.start", "m.end")


CENTERS = "ce AS (SELECT p_partkey, CAST(400 + p_size * 10 AS INT) AS h, list_transform(range(7), lambda i: (40 + i * (50 + p_partkey % 9) + (i * p_partkey) % 7)::DOUBLE) AS cs FROM part)"


def _centers(spark, d):
    key = F.col("p_partkey")
    centers = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long")), lambda i: (i * (key % 9 + 50) + 40 + (i * key) % 7).cast("double"))
    return views.read(spark, d, "part").select("p_partkey", (F.col("p_size") * 10 + 400).cast("int").alias("h"), centers.alias("cs"))


@query(f"""WITH {CENTERS}, e AS (SELECT *, list_median(list_transform(range(1, 6), lambda i: cs[i + 1] - cs[i])) * 0.48::DOUBLE AS reach FROM ce),
b AS (SELECT p_partkey, h, list_concat([cs[1] - reach], list_transform(range(1, 6), lambda i: (cs[i] + cs[i + 1]) / 2), [cs[6] + reach]) AS ed FROM e), k AS (SELECT *, unnest(range(6)) AS row FROM b)
SELECT p_partkey, row, CAST(greatest(0, round_even(ed[row + 1], 0)) AS INT) AS top, CAST(least(h, round_even(ed[row + 2], 0)) AS INT) AS bottom FROM k""")
def six_row_bounds(spark, d):
    six = F.slice("cs", 1, 6)
    return _centers(spark, d).select("p_partkey", F.posexplode(paper.six_row_bounds(six, F.col("h"))).alias("row", "b")).select("p_partkey", F.col("row").cast("long").alias("row"), "b.top", "b.bottom")


@query(f"""WITH {CENTERS}, k AS (SELECT *, unnest(range(1, 8)) AS i FROM ce), s AS (SELECT *, CASE WHEN i > 1 THEN cs[i] - cs[i - 1] ELSE cs[2] - cs[1] END AS up, CASE WHEN i < 7 THEN cs[i + 1] - cs[i] ELSE cs[7] - cs[6] END AS down FROM k)
SELECT p_partkey, i - 1 AS row, CAST(greatest(0, round_even(cs[i] - up * 0.82::DOUBLE, 0)) AS INT) AS top, CAST(least(h, round_even(cs[i] + down * 0.82::DOUBLE, 0)) AS INT) AS bottom FROM s""")
def sequential_row_bounds(spark, d):
    return _centers(spark, d).select("p_partkey", F.posexplode(paper.sequential_row_bounds(F.col("cs"), F.col("h"))).alias("row", "b")).select("p_partkey", F.col("row").cast("long").alias("row"), "b.top", "b.bottom")


@query(f"""WITH {CENTERS}, s AS (SELECT p_partkey, h, cs[1 : 5 + p_partkey % 3] AS cs, CAST(500 + p_partkey % 900 AS INT) AS w FROM ce)
SELECT p_partkey, least(500::DOUBLE, least(greatest(w, h), 1500 + p_partkey % 2 * 2000) / 10.0::DOUBLE) AS rate, CAST(greatest(4, floor(w * 0.025::DOUBLE + 0.5)) AS INT) AS overlap, CAST(least(w, floor(w / 2.0 + 0.5) + greatest(4, floor(w * 0.025::DOUBLE + 0.5))) AS INT) AS left_right, CAST(greatest(0, floor(w / 2.0 + 0.5) - greatest(4, floor(w * 0.025::DOUBLE + 0.5))) AS INT) AS right_left,
CAST(CASE WHEN len(cs) >= 7 THEN least(greatest(floor((cs[6] + cs[7]) / 2 + 0.5), 1), h) ELSE floor(h * 0.84::DOUBLE + 0.5) END AS INT) AS bottom, CASE WHEN w / h::DOUBLE < 1.35 AND h >= 480 THEN CAST(least(h, floor(h / 2.0 + 0.5) + greatest(8, floor(h * 0.04::DOUBLE + 0.5))) AS INT) ELSE -1 END AS upper_bottom, CASE WHEN w / h::DOUBLE < 1.35 AND h >= 480 THEN CAST(floor(h / 2.0 + 0.5) - greatest(8, floor(h * 0.04::DOUBLE + 0.5)) AS INT) ELSE -1 END AS lower_top FROM s""")
def page_crops(spark, d):
    c, key = F.col, F.col("p_partkey")
    s = _centers(spark, d).select("p_partkey", "h", F.slice("cs", F.lit(1), (key % 3 + 5).cast("int")).alias("cs"), (key % 900 + 500).cast("int").alias("w"))
    made = s.select("*", paper.two_panel_crops(c("w"), c("h"), c("cs")).alias("two"), paper.composite_crops(F.lit(0), F.lit(0), c("w"), c("h")).alias("more"), paper.effective_rate(c("w"), c("h"), key % 2 * 2000 + 1500).alias("rate"))
    return made.select("p_partkey", "rate", (c("two")[0]["right"] - F.floor(c("w") / 2 + 0.5).cast("int")).alias("overlap"), c("two")[0]["right"].alias("left_right"), c("two")[1]["left"].alias("right_left"), c("two")[0]["bottom"].alias("bottom"), F.coalesce(F.get("more", F.lit(0))["bottom"], F.lit(-1)).alias("upper_bottom"), F.coalesce(F.get("more", F.lit(1))["top"], F.lit(-1)).alias("lower_top"))


@query(f"""WITH {CENTERS}, k AS (SELECT *, unnest(range(9)) AS row, CAST(500 + p_partkey % 900 AS INT) AS w, p_partkey % 4 AS panel FROM ce), a AS (SELECT *, CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE row END AS pos FROM k)
SELECT p_partkey, row, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE panel * w / 4.0::DOUBLE END * 2 + 10 AS "left", CASE WHEN pos > 0 THEN (cs[pos] + cs[pos + 1]) / 2 ELSE 0 END * 3 + 20 AS top, CASE WHEN p_partkey % 5 = 0 THEN w ELSE (panel + 1) * w / 4.0::DOUBLE END * 2 + 10 AS "right", CASE WHEN pos < 6 THEN (cs[pos + 1] + cs[pos + 2]) / 2 ELSE h END * 3 + 20 AS bottom FROM a WHERE pos < 7""")
def source_regions(spark, d):
    c, key = F.col, F.col("p_partkey")
    each = _centers(spark, d).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(8).cast("long"))).alias("row"), (key % 900 + 500).cast("int").alias("w"))
    band = paper.source_band(c("cs"), c("row").cast("int"), (key % 4).cast("int"), F.lit(4), key % 5 == 0, c("w"), c("h"))
    w, h = c("w") * 2.0, c("h") * 3.0  # the source is twice as wide and three times as high, and was cropped at (5, 20 / 3)
    back = geometry.held(paper.transform_chain(w, h, c("w"), c("h"), F.lit(None).cast("array<double>"), F.lit(5.0), F.lit(20.0) / 3), geometry.inverse)
    held = each.withColumn("band", band).where("band is not null").withColumn("back", back)
    point = lambda x, y: geometry.project(c("back"), c("band")[x], c("band")[y])
    made = held.withColumn("a", point("left", "top")).withColumn("b", point("right", "bottom"))
    return made.select("p_partkey", "row", F.round(c("a")["x"], 6).alias("left"), F.round(c("a")["y"], 6).alias("top"), F.round(c("b")["x"], 6).alias("right"), F.round(c("b")["y"], 6).alias("bottom"))


# paths

PATH = "pa AS (SELECT series, sample + 10 AS x, value * 100 AS y, sample % 13 <> 5 AND (series + sample) % 29 <> 3 AS valid FROM v1)"


def _path(spark, d):
    v = views.regular_series(spark, d)
    return v.select("series", (F.col("sample") + 10).alias("x"), (F.col("value") * 100).alias("y"), ((F.col("sample") % 13 != 5) & ((F.col("series") + F.col("sample")) % 29 != 3)).alias("valid"))


@query(f"""WITH {V1}, {PATH}, ok AS (SELECT series, x, y, median(y) OVER (PARTITION BY series) AS base, (x - 8) / 69.0::DOUBLE * 199 AS p FROM pa WHERE valid),
n AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(p) OVER o AS p2 FROM ok WINDOW o AS (PARTITION BY series ORDER BY x)),
t AS (SELECT series, p, p2, y, y2, base, unnest(range(CAST(ceil(p) AS INT), CAST(floor(p2) AS INT) + 1)) AS target FROM n WHERE x2 = x + 1)
SELECT series, target, round(any_value(-((y + (y2 - y) * (target - p) / (p2 - p)) - base) * (1000.0::DOUBLE / 10 / 4)), 5) AS value FROM t WHERE target BETWEEN 0 AND 199 GROUP BY 1, 2""")
def path_to_canonical(spark, d):
    made = paths.canonical(_path(spark, d), ["series"], F.lit(8), F.lit(70), 200, F.lit(4.0), F.lit(10.0))
    return made.select("series", "target", F.round("value", 5).alias("value"))


RANGES = "rg AS (SELECT series, c AS col, 10 + c * 16 AS l, 10 + c * 16 + 14 + series % 3 AS r FROM (SELECT DISTINCT series FROM v1), (SELECT unnest(range(4)) AS c))"


@query(f"""WITH {V1}, {PATH}, {RANGES} SELECT pa.series, x, round(col * 2.5::DOUBLE + (x - l) / (r - l)::DOUBLE * 2.5, 9) AS time FROM pa JOIN rg ON rg.series = pa.series AND x >= l AND x < r""")
def source_times(spark, d):
    p = _path(spark, d)
    ranges = p.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("column")).select("series", "column", (F.col("column") * 16 + 10).alias("left"), (F.col("column") * 16 + 24 + F.col("series") % 3).alias("right"))
    return paths.timed(p, ranges, ["series"], 2.5).select("series", "x", F.round("time", 9).alias("time"))


@query(f"""WITH {V1}, {PATH}, f AS (SELECT series, x, x / 16.0::DOUBLE AS t, x % 17 < 2 AS flag FROM pa WHERE valid), iv AS (SELECT series, lag(t) OVER o AS a, t AS b, lag(x) OVER o = x - 1 AS joined, flag OR coalesce(lag(flag) OVER o, FALSE) AS touched FROM f WINDOW o AS (PARTITION BY series ORDER BY x)),
hit AS (SELECT DISTINCT series, unnest(range(CAST(ceil(a * 40) AS BIGINT), CAST(floor(b * 40) AS BIGINT) + 1)) AS sample FROM iv WHERE joined AND touched)
SELECT s.series, s.sample, s.value, s.value IS NOT NULL AND hit.sample IS NOT NULL AS review FROM (SELECT series, CAST(sample * 3 AS BIGINT) AS sample, CASE WHEN sample % 7 <> 2 THEN value END AS value FROM v1) s LEFT JOIN hit ON hit.series = s.series AND hit.sample = s.sample""")
def review_flags(spark, d):
    p = _path(spark, d).select("series", "x", (F.col("x") / 16.0).alias("time"), "valid", (F.col("x") % 17 < 2).alias("flagged"))
    s = views.regular_series(spark, d).select("series", (F.col("sample") * 3).cast("long").alias("sample"), F.when(F.col("sample") % 7 != 2, F.col("value")).alias("value"))
    return paths.review_flags(s, p, ["series"], 40)


SIDES = "sd AS (SELECT series // 2 AS page, series % 2 AS side, grp AS lead, sample, CASE WHEN (series + sample) % 11 <> 4 THEN value END AS value FROM v1)"


@query(f"""WITH {V1}, {SIDES}, w AS (SELECT page, lead, sample, value, lead(sample) OVER o AS s2, lead(value) OVER o AS v2, lag(sample) OVER o AS s0 FROM sd WHERE side = lead % 2 AND value IS NOT NULL WINDOW o AS (PARTITION BY page, lead ORDER BY sample)),
t AS (SELECT page, lead, sample, s2, value, v2, unnest(CASE WHEN s2 = sample + 1 THEN range(CAST(ceil(sample * (99 / 63.0::DOUBLE)) AS INT), CAST(floor(s2 * (99 / 63.0::DOUBLE)) AS INT) + 1) WHEN s0 IS NOT DISTINCT FROM sample - 1 THEN []::BIGINT[] ELSE [CAST(floor(sample * (99 / 63.0::DOUBLE) + 0.5) AS BIGINT)] END) AS target FROM w)
SELECT page, lead, target + CASE WHEN lead % 2 = 0 THEN 0 ELSE 100 END AS sample, round(any_value(CASE WHEN s2 = sample + 1 THEN value + (v2 - value) * (target / (99 / 63.0::DOUBLE) - sample) ELSE value END), 6) AS value FROM t WHERE target BETWEEN 0 AND 99 GROUP BY 1, 2, target""")
def composed_pages(spark, d):
    v = views.regular_series(spark, d)
    sides = v.select(F.floor(F.col("series") / 2).alias("page"), (F.col("series") % 2).alias("side"), F.col("grp").alias("lead"), "sample", F.when((F.col("series") + F.col("sample")) % 11 != 4, F.col("value")).alias("value"))
    out = paths.composed(sides, ["page", "lead"], F.col("side") == F.col("lead") % 2, F.when(F.col("lead") % 2 == 0, 0).otherwise(100), 64, 100)
    return out.select("page", "lead", "sample", F.round("value", 6).alias("value"))


# the cheapest path over eight columns of eight rows, column by column

_FAR = "pow(abs(r - 3.5::DOUBLE) / 4, 4)"
_LOCAL = f"lc AS (SELECT vec_id AS panel, x, r, 7 * (1 - (abs(embedding[x * 8 + r + 1])::DOUBLE - floor(abs(embedding[x * 8 + r + 1])::DOUBLE))) + 0.35::DOUBLE * {_FAR} AS c FROM embeddings, (SELECT unnest(range(8)) AS x), (SELECT unnest(range(8)) AS r))"
_STEP = "s{k} AS (SELECT l.panel, l.r, min(p.c + 0.035::DOUBLE * abs(l.r - p.r) + 0.0018::DOUBLE * (l.r - p.r) * (l.r - p.r)) + any_value(l.c) AS c, arg_min(p.path, p.c + 0.035::DOUBLE * abs(l.r - p.r) + 0.0018::DOUBLE * (l.r - p.r) * (l.r - p.r)) || [l.r] AS path FROM lc l JOIN s{p} p ON p.panel = l.panel WHERE l.x = {k} GROUP BY 1, 2)"


@query(f"""WITH {_LOCAL}, s0 AS (SELECT panel, r, c, [r] AS path FROM lc WHERE x = 0), {', '.join(_STEP.format(k=k, p=k - 1) for k in range(1, 8))}, b AS (SELECT panel, arg_min(path, c) AS path FROM s7 GROUP BY 1)
SELECT panel, CAST(generate_subscripts(path, 1) - 1 AS INT) AS x, CAST(unnest(path) + 10 AS INT) AS y FROM b""")
def traced_panels(spark, d):
    e = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("panel"), F.transform("embedding", lambda v: F.abs(v).cast("double") - F.floor(F.abs(v).cast("double"))).alias("ink"))
    each = e.select("panel", "ink", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("x"))
    return grouped.traced(each.select("panel", "x", F.lit(10).alias("y_start"), F.lit(13.5).alias("row_center"), F.slice("ink", F.col("x") * 8 + 1, F.lit(8)).alias("evidence")))


@query(f"""WITH {V1}, {PATH}, rr AS (SELECT s.series, c AS part, 10 + c * 16 AS l, 26 + c * 16 AS r FROM (SELECT DISTINCT series FROM v1) s, (SELECT unnest(range(4)) AS c)),
ok AS (SELECT series, x, y, median(y) OVER (PARTITION BY series) AS base FROM pa WHERE valid), q AS (SELECT ok.*, part, (x - l) / 15.0::DOUBLE * 39 AS p FROM ok JOIN rr ON rr.series = ok.series AND x >= l AND x < r),
n AS (SELECT *, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(p) OVER o AS p2 FROM q WINDOW o AS (PARTITION BY series, part ORDER BY x)),
t AS (SELECT series, part, p, p2, y, y2, base, unnest(range(CAST(ceil(p) AS INT), CAST(floor(p2) AS INT) + 1)) AS target FROM n WHERE x2 = x + 1)
SELECT series, part * 40 + target AS target, round(any_value(-((y + (y2 - y) * (target - p) / (p2 - p)) - base) * 25), 5) AS value FROM t WHERE target <= 39 GROUP BY 1, 2, part""")
def rhythm_to_canonical(spark, d):
    p = _path(spark, d)
    ranges = p.select("series").distinct().select("series", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("part")).select("series", "part", (F.col("part") * 16 + 10).alias("left"), (F.col("part") * 16 + 26).alias("right"))
    return paths.rhythm(p, ranges, ["series"], 40, F.lit(4.0), F.lit(10.0)).select("series", F.col("target").cast("long").alias("target"), F.round("value", 5).alias("value"))


@query("""WITH e AS (SELECT user_id AS k, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) % 800 AS x FROM events), f AS (SELECT DISTINCT k, 50 + k % 40 AS s, 600 + k % 90 AS e2, k % 3 AS t, 300 + k % 11 AS te FROM e)
SELECT DISTINCT e.k, CAST(round_even(t + (x - s) * (te - t - 1) / (e2 - s - 1)::DOUBLE, 0) AS INT) AS x FROM e JOIN f ON f.k = e.k WHERE x >= s AND x < e2""")
def moved_events(spark, d):
    e = views.read(spark, d, "events").select(F.col("user_id").alias("k"), (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).cast("long") % 800).alias("x"))
    k = F.col("k")
    frames = e.select("k").distinct().select("k", (k % 40 + 50).alias("start"), (k % 90 + 600).alias("end"), (k % 3).alias("to"), (k % 11 + 300).alias("to_end"))
    return paths.moved_events(e, frames, ["k"])


@query(f"""WITH {V1}, o AS (SELECT series, sample, CASE WHEN sample >= 20 AND sample < 20 + series % 5 THEN NULL WHEN series % 7 = 0 AND sample = 3 THEN value + 1 ELSE value END AS v, value FROM v1),
p AS (SELECT series, bool_and(CASE WHEN sample >= 20 AND sample < 20 + series % 5 THEN v IS NULL ELSE series % 4 > 0 AND v = value END) AS ok, series % 11 > 0 AS one FROM o GROUP BY series) SELECT series, ok AND one AS copied FROM p""")
def direct_copies(spark, d):
    s, at = F.col("series"), F.col("sample")
    v = views.regular_series(spark, d).select("series", at.cast("long").alias("sample"), "value")
    hole = (at >= 20) & (at < 20 + s % 5)
    out = v.withColumn("value", F.when(hole, None).when((s % 7 == 0) & (at == 3), F.col("value") + 1).otherwise(F.col("value")))
    span = lambda a, b, op: F.struct(a.cast("long").alias("start"), b.cast("long").alias("end"), F.lit(op).alias("operation"))
    spans = v.select("series").distinct().select("series", F.explode(F.array(span(F.lit(0), F.lit(20), "selected_samples"), span(F.lit(20), 20 + s % 5, "missing"), span(20 + s % 5, F.lit(64), "selected_samples"))).alias("p")).select("series", "p.*", F.when(s % 11 > 0, 1).otherwise(2).alias("contributors"), (s % 4 > 0).alias("direct"))
    return paths.direct_copies(spans, out, v, ["series"])
