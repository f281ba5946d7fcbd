"""Queries on the time axis of pages, with their oracles by window functions.

Suppliers are pages. Their ink follows from the key: which stretches of columns have ink (by a scenario, key % 8, so that every
branch and every refusal occurs), and how far it lies from its row's centre.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import ranges
from lacuna.queries import query
from lacuna.sources import views

# six rows of two panels

_SIX = {0: "x BETWEEN 8 AND 57 - k % 3 OR x BETWEEN 80 AND 131", 1: "x BETWEEN 6 AND 109 + k % 4", 2: "x BETWEEN 10 AND 104", 3: "(x BETWEEN 10 AND 59 OR x BETWEEN 80 AND 129) AND x % 3 <> 0", 4: "(x BETWEEN 3 AND 67 OR x BETWEEN 74 AND 123) AND x % 3 <> 0", 5: "x % 11 = 0", 6: "(x BETWEEN 13 AND 62 OR x BETWEEN 64 AND 109) AND x % 4 <> 0", 7: "(x BETWEEN 12 AND 70 OR x BETWEEN 75 AND 125) AND x % 5 <> k % 5"}
_WIDTH6 = "CASE WHEN k % 8 = 6 THEN 110 ELSE 140 + k % 3 END"
_CASES = lambda cases: "CASE " + " ".join(f"WHEN k % 8 = {n} THEN {cond}" for n, cond in cases.items()) + " END"
_INK = "CASE WHEN (k + x * 3 + row) % 17 = 0 THEN 0.1 ELSE 0.25 + ((k + x + row) % 7) / 10.0 END"


def _pages(spark, d, width: str, n_rows: int, step: int, present: str, far: str):
    """pages (k, width, height), rows and pixels; present and far are over k, row, x."""
    s = views.read(spark, d, "supplier").selectExpr("s_suppkey AS k").selectExpr("k", f"CAST({width} AS INT) AS width", f"{step * (n_rows + 1)} AS height")
    rows = s.selectExpr("k", f"explode(sequence(0, {n_rows - 1})) AS row").selectExpr("k", "row", f"CAST({step} + row * {step} + k % 3 AS INT) AS center")
    pixels = s.selectExpr("k", "width", f"explode(sequence(0, {n_rows - 1})) AS row").selectExpr("k", "row", "explode(sequence(0, width - 1)) AS x").where(present)
    return s, rows, pixels.selectExpr("k", f"CAST({step} + row * {step} + k % 3 + {far} AS INT) AS y", "x", f"CAST({_INK} AS DOUBLE) AS ink")


def _sql_pages(width: str, n_rows: int, step: int, present: str, far: str) -> str:
    """CTEs pg (k, w) and px (k, row, x, far, ink); the rows' spacing is `step`, so no pixel is in another row's band."""
    return f"""pg AS (SELECT s_suppkey AS k FROM supplier), pw AS (SELECT k, CAST({width} AS INT) AS w FROM pg), gx AS (SELECT k, w, row, unnest(range(w)) AS x FROM pw, (SELECT unnest(range({n_rows})) AS row)),
px AS (SELECT k, w, row, x, abs({far}) AS far, CAST({_INK} AS DOUBLE) AS ink FROM gx WHERE {present})"""


_FAR6, _D6, _STEP6 = "((x * 7 + row * 3 + k) % 5 - 2) * 2", 50, 20
#: Whether the ink of a column lies on the rows or beside them.
_FLAT = "CASE WHEN k % 8 IN (3, 4, 6, 7) THEN 0 ELSE {far} END"


@query(f"""WITH {_sql_pages(_WIDTH6, 6, _STEP6, _CASES(_SIX), _FLAT.format(far=_FAR6))},
sh AS (SELECT k, x, list_median(list(CASE WHEN far <= 2 THEN ink ELSE 0 END) || list_transform(range(6 - count(*)), lambda i: 0.0::DOUBLE)) >= 0.24 AS active, count(*) FILTER (far <= 8 AND ink >= 0.24) >= 3 AS inked FROM px GROUP BY 1, 2),
dn AS (SELECT k, w, g.x, coalesce(active, FALSE) AS active, coalesce(inked, FALSE) AS inked FROM (SELECT DISTINCT k, w, x FROM gx) g LEFT JOIN sh USING (k, x)),
ru AS (SELECT k, min(x) AS s, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY k ORDER BY x) AS isl FROM dn WHERE inked) GROUP BY k, isl HAVING count(*) >= {_D6} * 0.75),
r1 AS (SELECT k, count(*) AS c, min(s) AS s, max(s + n) AS e FROM ru WHERE n BETWEEN {_D6} * 0.85 AND {_D6} * 1.15 GROUP BY 1),
c1 AS (SELECT k, 'runs' AS method, s AS ls, s + {_D6} AS le, e - {_D6} AS rs, e AS re FROM r1 WHERE c >= 2 AND s + {_D6} <= e - {_D6}),
r2 AS (SELECT k, arg_min(s, (abs(n - {2 * _D6}), s)) AS s, arg_min(n, (abs(n - {2 * _D6}), s)) AS n FROM ru WHERE n BETWEEN {_D6} * 1.85 AND {_D6} * 2.15 GROUP BY 1),
c2 AS (SELECT k, CASE WHEN n >= {2 * _D6} THEN 'double_run' ELSE 'split_run' END AS method, s AS ls, CASE WHEN n >= {2 * _D6} THEN s + {_D6} ELSE round_even((2 * s + n) / 2, 0) END AS le, CASE WHEN n >= {2 * _D6} THEN s + n - {_D6} ELSE round_even((2 * s + n) / 2, 0) END AS rs, s + n AS re FROM r2 WHERE n >= {2 * _D6} OR abs(round_even(n / 2, 0) - {_D6}) <= {_D6} * 0.08),
wn AS (SELECT k, w, x, active, sum(active::INT) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND {_D6 - 1} FOLLOWING) AS score FROM dn),
w1 AS (SELECT k, arg_max(x, (score, -x)) AS ls, max(score) AS lscore FROM wn WHERE x BETWEEN round_even(w / 2 * 0.04, 0) AND least(w - {_D6}, round_even(w / 2 * 0.24, 0)) GROUP BY 1),
w2 AS (SELECT k, arg_max(x, (score, -x)) AS rs, max(score) AS rscore FROM wn WHERE x BETWEEN round_even(1.04 * w / 2, 0) AND least(w - {_D6}, round_even(1.24 * w / 2, 0)) GROUP BY 1),
ho AS (SELECT k, min(x) AS g, count(*) AS n FROM (SELECT *, x - row_number() OVER (PARTITION BY k ORDER BY x) AS isl FROM dn WHERE NOT active AND x >= round_even(w * 0.485, 0) AND x < round_even(w * 0.515, 0)) GROUP BY k, isl),
gu AS (SELECT k, arg_max(g, (n, -g)) AS g FROM ho JOIN pw USING (k) WHERE n >= greatest(4, round_even(w * 0.004, 0)) GROUP BY 1),
w3 AS (SELECT w1.k, w, ls, rs, lscore, g, (SELECT score FROM wn WHERE wn.k = w1.k AND wn.x = g - {_D6}) AS gscore FROM w1 JOIN w2 USING (k) JOIN pw USING (k) LEFT JOIN gu USING (k) WHERE lscore >= {_D6} * 0.2 AND rscore >= {_D6} * 0.2),
w4 AS (SELECT k, rs, coalesce(ls < w * 0.03 AND g - {_D6} >= 0 AND g - {_D6} >= ls + w * 0.01 AND g <= rs AND rs - g <= w * 0.08 AND gscore >= lscore * 0.85, FALSE) AS moved, ls, g FROM w3),
c3 AS (SELECT k, CASE WHEN moved THEN 'window_to_gutter' ELSE 'windows' END AS method, CASE WHEN moved THEN g - {_D6} ELSE ls END AS ls, CASE WHEN moved THEN g ELSE ls + {_D6} END AS le, rs, rs + {_D6} AS re FROM w4 WHERE CASE WHEN moved THEN g ELSE ls + {_D6} END <= rs),
al AS (SELECT 1 AS tier, * FROM c1 UNION ALL SELECT 2, * FROM c2 UNION ALL SELECT 3, * FROM c3)
SELECT k, method, CAST(ls AS INT) AS left_start, CAST(le AS INT) AS left_end, CAST(rs AS INT) AS right_start, CAST(re AS INT) AS right_end FROM al QUALIFY row_number() OVER (PARTITION BY k ORDER BY tier) = 1""")
def six_by_two_ranges(spark, d):
    pages, rows, pixels = _pages(spark, d, _WIDTH6, 6, _STEP6, _CASES(_SIX), _FLAT.format(far=_FAR6))
    found = ranges.six_by_two(pixels, rows, pages.selectExpr("*", "0.4D AS pixels_per_mm", "25D AS speed"), ["k"])
    return found.selectExpr("k", "method", "left.start AS left_start", "left.end AS left_end", "right.start AS right_start", "right.end AS right_end")


# three rows of four panels

_D3 = 50
_WIDTH3 = "236 + k % 5"
_THREE = {0: "x BETWEEN 12 AND 215", 1: "x BETWEEN 9 AND 220 AND x % 50 > 2", 2: "x BETWEEN 7 AND 60 OR x BETWEEN 66 AND 230", 3: "x % 4 = 0", 4: "x % 7 = 0", 5: "x BETWEEN 15 AND 120", 6: "x BETWEEN 5 AND 235 AND x % 9 <> 4", 7: "x BETWEEN 6 AND 61 AND x % 3 = 0 OR x BETWEEN 64 AND 232"}
_LABELS3 = "CASE WHEN k % 8 = 0 THEN 14 + 50 * i + CASE WHEN k % 16 = 8 AND i = 2 THEN 9 ELSE i END WHEN k % 8 = 4 THEN 12 + 50 * i WHEN k % 8 = 6 AND i = 3 THEN NULL WHEN k % 8 = 6 THEN 10.5 + 50 * i END"


def _onset(k: int) -> str:
    lo = "CAST(greatest(0, round_even(w / 4 * 0.04, 0)) AS INT)" if k == 0 else f"q{k - 1}.e"
    frm = "pw" if k == 0 else f"q{k - 1} JOIN pw USING (k)"
    return f"""b{k} AS (SELECT k, w, {lo} AS lo, CAST(least(w - {_D3}, round_even({k}.36 * w / 4, 0)) AS INT) AS hi FROM {frm}),
q{k} AS (SELECT b.k, coalesce(min(x) FILTER (good), CASE WHEN max(score) >= {_D3} * 0.2 THEN arg_max(x, (score, -x)) END) AS s, coalesce(min(x) FILTER (good), arg_max(x, (score, -x))) + {_D3} AS e, CASE WHEN bool_or(good) THEN 'onset' ELSE 'window' END AS method FROM b{k} b JOIN wn ON wn.k = b.k AND wn.x BETWEEN lo AND hi GROUP BY 1 HAVING bool_or(good) OR max(score) >= {_D3} * 0.2)"""


@query(f"""WITH {_sql_pages(_WIDTH3, 3, 30, _CASES(_THREE), "0")},
sh AS (SELECT k, x, list_median(list(ink) || list_transform(range(3 - count(*)), lambda i: 0.0::DOUBLE)) >= 0.24 AS active FROM px GROUP BY 1, 2),
dn AS (SELECT k, w, g.x, coalesce(active, FALSE) AS active FROM (SELECT DISTINCT k, w, x FROM gx) g LEFT JOIN sh USING (k, x)),
zr AS (SELECT *, x - coalesce(max(x) FILTER (active) OVER (PARTITION BY k ORDER BY x), -1) AS zeros FROM dn),
wn AS (SELECT k, x, sum(active::INT) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND {_D3 - 1} FOLLOWING) AS score, active AND sum(active::INT) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) / 12 >= 0.55 AND max(zeros) OVER (PARTITION BY k ORDER BY x ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING) <= 4 AS good FROM zr),
{_onset(0)}, {_onset(1)}, {_onset(2)}, {_onset(3)},
lb AS (SELECT k, w, i, CAST(round_even({_LABELS3} - 0.8, 0) AS INT) AS s FROM pw, (SELECT unnest(range(4)) AS i)), ln AS (SELECT *, lead(s) OVER (PARTITION BY k ORDER BY i) AS nxt FROM lb),
lk AS (SELECT ln.k FROM ln LEFT JOIN wn ON wn.k = ln.k AND wn.x = ln.s GROUP BY ln.k HAVING count(s) = 4 AND bool_and(s >= 0 AND s + {_D3} <= w AND score >= {_D3} * 0.2 AND (nxt IS NULL OR (abs(nxt - s - {_D3}) <= 4 AND s + {_D3} <= nxt + 4)))),
al AS (SELECT k, TRUE AS labeled, i, s, s + {_D3} AS e, 'label' AS method FROM lb SEMI JOIN lk USING (k) UNION ALL SELECT k, FALSE, i, s, e, method FROM ({' UNION ALL '.join(f'SELECT k, {i} AS i, s, e, method FROM q{i}' for i in range(4))}) SEMI JOIN q3 USING (k) ANTI JOIN lk USING (k))
SELECT k, labeled, CAST(i AS INT) AS panel, CAST(s AS INT) AS "start", CAST(e AS INT) AS "end", method FROM al""")
def three_by_four_ranges(spark, d):
    pages, rows, pixels = _pages(spark, d, _WIDTH3, 3, 30, _CASES(_THREE), "0")
    labels = "transform(sequence(0, 3), i -> CAST(" + _LABELS3 + " AS DOUBLE))"
    found = ranges.three_by_four(pixels, rows, pages.selectExpr("*", "0.8D AS pixels_per_mm", "25D AS speed", f"CASE WHEN k % 8 IN (0, 4, 6) THEN {labels} END AS label_edges"), ["k"])
    return found.select("k", "labeled", F.posexplode("ranges").alias("panel", "r")).selectExpr("k", "labeled", "panel", "r.start", "r.end", "r.method")


# twelve rows of ten seconds: a page leans by its key, some rows of it are spoilt

_W12, _STEP12 = "230 + k % 7", 12
_LEAN = "CAST(rint(row * ((k % 5) - 2) * 0.4) AS INT)"
_SPOILT = "CASE WHEN k % 6 = 1 AND row = 4 THEN 9 WHEN k % 6 = 2 AND row IN (1, 5, 9) THEN 8 WHEN k % 6 = 3 AND row % 3 = 0 THEN 10 ELSE 0 END"
_S12, _E12 = f"(16 + {_LEAN} + {_SPOILT})", f"(218 + {_LEAN} - CASE WHEN k % 6 = 4 AND row = 7 THEN 20 ELSE 0 END)"
_PRESENT12 = f"((x >= {_S12} AND x < {_E12} AND (x + row) % 6 <> 5 AND (k % 13 <> 12 OR x % 2 = 0)) OR (k % 6 = 5 AND x < CASE WHEN k % 12 = 11 THEN 12 ELSE 6 END))"
_INK12 = "CASE WHEN (k + x * 3 + row) % 19 = 0 THEN 0.5 ELSE 0.75 + ((k + x + row) % 3) / 10.0 END"
_PX12 = f"""pw AS (SELECT s_suppkey AS k, CAST({_W12} AS INT) AS w FROM supplier), gx AS (SELECT k, w, row, unnest(range(w)) AS x FROM pw, (SELECT unnest(range(12)) AS row)),
px AS (SELECT k, w, row, x, coalesce({_PRESENT12.replace('rint(', 'round_even(').replace('0.4)', '0.4::DOUBLE, 0)')}, FALSE) AS there, CAST({_INK12} AS DOUBLE) AS ink FROM gx)"""
_THEIL = lambda name, value: f"""{name}_s AS (SELECT a.k, median((b.{value} - a.{value}) / (b.row - a.row)::DOUBLE / {_STEP12}) AS m FROM rw a JOIN rw b ON a.k = b.k AND a.row < b.row GROUP BY 1), {name}_l AS (SELECT k, m, median({value} - m * ax) AS b FROM rw JOIN {name}_s USING (k) GROUP BY 1, 2), {name} AS (SELECT k, row, round_even(b + m * ax, 0) AS p FROM rw JOIN {name}_l USING (k))"""


def _twelve(spark, d):
    s = views.read(spark, d, "supplier").selectExpr("s_suppkey AS k").selectExpr("k", f"CAST({_W12} AS INT) AS width", f"{_STEP12 * 13} AS height")
    rows = s.selectExpr("k", "explode(sequence(0, 11)) AS row").selectExpr("k", "row", f"CAST({_STEP12} + row * {_STEP12} AS INT) AS center", "1D + (k % 3) * 0.0025D AS pixels_per_mm")
    pixels = s.selectExpr("k", "width", "explode(sequence(0, 11)) AS row").selectExpr("k", "row", "explode(sequence(0, width - 1)) AS x").where(_PRESENT12)
    return s, rows, pixels.selectExpr("k", f"CAST({_STEP12} + row * {_STEP12} AS INT) AS y", "x", f"CAST({_INK12} AS DOUBLE) AS ink")


_CAL12, _GRID12 = "CASE WHEN k % 6 = 5 THEN 12 END", "CASE WHEN k % 7 = 6 THEN 2.6 WHEN k % 7 < 3 THEN 1.05 ELSE 5.1 END"


@query(f"""WITH {_PX12}, ac AS (SELECT k, w, row, x, there AND ink >= 0.7 AND ({_CAL12} IS NULL OR x > {_CAL12}) AS a FROM px),
sm AS (SELECT k, w, row, x, a, avg(a::INT) OVER (PARTITION BY k, row ORDER BY x ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING) AS nx, avg(a::INT) OVER (PARTITION BY k, row ORDER BY x ROWS BETWEEN 31 PRECEDING AND CURRENT ROW) AS pv FROM ac),
rw AS (SELECT k, w, row, {_STEP12} + row * {_STEP12} AS ax, min(x) FILTER (a AND nx >= 0.45 AND x BETWEEN round_even(w * 0.04, 0) AND round_even(w * 0.20, 0))::DOUBLE AS s, 1.0::DOUBLE + max(x) FILTER (a AND pv >= 0.45 AND x >= round_even(w * 0.80, 0) AND x < round_even(w * 0.98, 0)) AS e FROM sm GROUP BY 1, 2, 3),
{_THEIL("ps", "s")}, {_THEIL("pe", "e")},
pg AS (SELECT rw.k, w, count(s) AS ns, count(e) AS ne, bool_and(e > s) AS ok, count(*) FILTER (s <= round_even(w * 0.04, 0)) AS es, count(*) FILTER (e >= round_even(w * 0.98, 0)) AS ee, median(e - s) / 200 AS mm FROM rw GROUP BY 1, 2),
jn AS (SELECT rw.k, rw.row, rw.w, s, e, ps.p AS ps, pe.p AS pe, mm FROM rw JOIN ps USING (k, row) JOIN pe USING (k, row) JOIN pg USING (k) WHERE ns = 12 AND ne = 12 AND ok AND es <= 2 AND ee <= 2 AND mm BETWEEN 1.0 AND 40.0),
gr AS (SELECT k, w, any_value({_GRID12}) AS grid, count(*) FILTER (abs(s - ps) > greatest(2, ceil(mm * 0.75)) OR abs(e - pe) > greatest(2, ceil(mm * 0.75))) AS corrected, count(*) FILTER (s <> ps OR e <> pe) AS projected, min((pe - ps) / w) AS lo, max((pe - ps) / w) AS hi, median(pe - ps) / 200 AS mm FROM jn GROUP BY 1, 2),
sc AS (SELECT *, grid / mm AS ratio, CASE WHEN abs(grid / mm - 1) <= abs(grid / mm - 5) THEN 1.0 ELSE 5.0 END AS g FROM gr WHERE corrected <= 3 AND lo >= 0.78 AND hi <= 0.96)
SELECT k, CAST(row AS INT) AS row, CAST(ps AS INT) AS "start", CAST(pe AS INT) AS "end", CAST(corrected AS INT) AS corrected, CAST(projected AS INT) AS projected, round(sc.mm, 9) AS pixels_per_mm, g::DOUBLE AS grid_mm, round(abs(ratio - g) / g, 9) AS scale_error FROM sc JOIN jn USING (k) WHERE abs(ratio - g) / g <= 0.12""")
def twelve_row_consensus(spark, d):
    pages, rows, pixels = _twelve(spark, d)
    found = ranges.twelve_consensus(pixels, rows.drop("pixels_per_mm"), pages.selectExpr("*", f"CAST({_GRID12} AS DOUBLE) AS grid_period", "20D AS speed", f"CAST({_CAL12} AS INT) AS calibration_end"), ["k"])
    return found.select("k", F.posexplode("ranges").alias("row", "r"), "corrected", "projected", F.round("pixels_per_mm", 9).alias("pixels_per_mm"), "grid_mm", F.round("scale_error", 9).alias("scale_error")).select("k", "row", "r.start", "r.end", "corrected", "projected", "pixels_per_mm", "grid_mm", "scale_error")


_CALO12 = "CASE WHEN k % 4 = 1 THEN 9 END"


@query(f"""WITH {_PX12}, pr AS (SELECT k, w, mm, d, greatest(0, round_even(w * 0.012, 0), coalesce({_CALO12}, 0)) AS lo, least(w - d, round_even(w * 0.18, 0)) AS hi FROM (SELECT k, w, 1::DOUBLE + (k % 3) * 0.0025::DOUBLE AS mm, CAST(round_even((1::DOUBLE + (k % 3) * 0.0025::DOUBLE) * 20 * 10, 0) AS INT) AS d FROM pw)),
zr AS (SELECT k, row, x, there AS a, x - coalesce(max(x) FILTER (there) OVER (PARTITION BY k, row ORDER BY x), -1) AS zeros, sum(there::INT) OVER (PARTITION BY k, row ORDER BY x) AS cum FROM px),
wn AS (SELECT *, a AND avg(a::INT) OVER o >= 0.55 AND max(zeros) OVER o <= 3 AS good, cum - a::INT AS before FROM zr WINDOW o AS (PARTITION BY k, row ORDER BY x ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
er AS (SELECT k, row, min(x) AS s, max(x) + 1 AS e FROM (SELECT k, row, x, x - row_number() OVER (PARTITION BY k, row ORDER BY x) AS isl FROM zr JOIN pr USING (k) WHERE a AND x >= lo AND x < least(hi + 1, greatest(lo, round_even(w * 0.08, 0)))) GROUP BY k, row, isl),
og AS (SELECT k, w, mm, d, hi, row, CASE WHEN {_CALO12} IS NULL THEN greatest(lo, coalesce((SELECT max(e) FROM er WHERE er.k = pr.k AND er.row = r.row AND s <= w * 0.045 AND e - s <= greatest(3, round_even(mm * 5.5, 0))), lo)) ELSE lo END AS lo FROM pr, (SELECT unnest(range(12)) AS row) r),
st AS (SELECT og.k, og.row, w, mm, d, coalesce(min(a.x) FILTER (a.good), CASE WHEN max(b.cum - a.before) >= d * 0.2 THEN arg_max(a.x, (b.cum - a.before, -a.x)) END)::DOUBLE AS s FROM og JOIN wn a ON a.k = og.k AND a.row = og.row AND a.x BETWEEN lo AND hi JOIN wn b ON b.k = a.k AND b.row = a.row AND b.x = a.x + d - 1 WHERE lo <= hi GROUP BY og.k, og.row, w, mm, d),
rw AS (SELECT *, {_STEP12} + row * {_STEP12} AS ax FROM st WHERE (SELECT count(s) FROM st o WHERE o.k = st.k) = 12), {_THEIL("ps", "s")},
jn AS (SELECT k, row, w, d, ax, s, p, abs(s - p) AS rest, abs(s - p) > greatest(2, ceil(mm * 0.75)) AS off, count(*) FILTER (abs(s - p) > greatest(2, ceil(mm * 0.75))) OVER (PARTITION BY k) AS corrected FROM rw JOIN ps USING (k, row)),
mv AS (SELECT *, CASE WHEN corrected <= 3 AND off THEN p ELSE s END AS ns FROM jn),
ft AS (SELECT k, regr_slope(ns, ax) AS m, regr_intercept(ns, ax) AS b, regr_slope(ns + d, ax) AS m2, regr_intercept(ns + d, ax) AS b2 FROM mv GROUP BY 1),
ok AS (SELECT k, bool_and(corrected <= 3) AND max(abs(ns - m * ax - b)) <= any_value(w) * 0.025 AND max(abs(ns + d - m2 * ax - b2)) <= any_value(w) * 0.035 AND max(ns) - min(ns) <= any_value(w) * 0.18 AS accepted, max(rest) AS residual FROM mv JOIN ft USING (k) GROUP BY 1)
SELECT k, CAST(row AS INT) AS row, accepted, CAST(CASE WHEN accepted THEN ns END AS INT) AS "start", CAST(CASE WHEN accepted THEN ns + d END AS INT) AS "end", CAST(corrected AS INT) AS corrected, CAST(residual AS INT) AS residual FROM mv JOIN ok USING (k)""")
def twelve_row_origins(spark, d):
    pages, rows, pixels = _twelve(spark, d)
    found = ranges.twelve_origins(pixels, rows, pages.selectExpr("*", "20D AS speed", f"CAST({_CALO12} AS INT) AS calibration_end"), ["k"])
    each = found.select("k", "accepted", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("row"), "ranges", "corrected", "residual").withColumn("r", F.get("ranges", F.col("row")))
    return each.select("k", "row", "accepted", "r.start", "r.end", "corrected", "residual")


_SPANS = f"""{_PX12}, ac AS (SELECT k, w, row, x, there AND ink >= 0.7 AS a FROM px), zr AS (SELECT *, x - coalesce(max(x) FILTER (a) OVER (PARTITION BY k, row ORDER BY x), -1) AS zeros FROM ac),
sm AS (SELECT k, w, row, x, a, avg(a::INT) OVER n32 AS nx, avg(a::INT) OVER p32 AS pv, min(a::INT) OVER (PARTITION BY k, row ORDER BY x ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) = 1 AS solid, min(a::INT) OVER (PARTITION BY k, row ORDER BY x ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 1 AS solid_before,
avg(a::INT) OVER n24 >= 0.72 AND max(zeros) OVER n24 <= 6 AS dense, avg(a::INT) OVER p24 >= 0.72 AND max(least(zeros, 24)) OVER p24 <= 6 AS dense_before FROM zr
WINDOW n32 AS (PARTITION BY k, row ORDER BY x ROWS BETWEEN CURRENT ROW AND 31 FOLLOWING), p32 AS (PARTITION BY k, row ORDER BY x ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), n24 AS (PARTITION BY k, row ORDER BY x ROWS BETWEEN CURRENT ROW AND 23 FOLLOWING), p24 AS (PARTITION BY k, row ORDER BY x ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
rw AS (SELECT k, row, min(x) FILTER (a AND nx >= 0.45 AND x BETWEEN round_even(w * 0.04, 0) AND round_even(w * 0.20, 0)) AS s, 1 + max(x) FILTER (a AND pv >= 0.45 AND x >= round_even(w * 0.80, 0) AND x < round_even(w * 0.98, 0)) AS e,
min(x) FILTER (solid AND dense AND x BETWEEN round_even(w * 0.04, 0) AND round_even(w * 0.20, 0)) AS s2, 1 + max(x) FILTER (solid_before AND dense_before AND x + 1 BETWEEN round_even(w * 0.80, 0) AND round_even(w * 0.98, 0)) AS e2 FROM sm GROUP BY 1, 2)"""


@query(f"""WITH {_SPANS} SELECT k, CAST(row AS INT) AS row, CAST(CASE WHEN e > s THEN s END AS INT) AS edge_start, CAST(CASE WHEN e > s THEN e END AS INT) AS edge_end, CAST(CASE WHEN e2 > s2 THEN s2 END AS INT) AS sustained_start, CAST(CASE WHEN e2 > s2 THEN e2 END AS INT) AS sustained_end FROM rw""")
def twelve_row_spans(spark, d):
    pages, rows, pixels = _twelve(spark, d)
    found = ranges.row_spans(pixels, rows.drop("pixels_per_mm"), pages, ["k"])
    return found.selectExpr("k", "row", "edges.start AS edge_start", "edges.end AS edge_end", "sustained.start AS sustained_start", "sustained.end AS sustained_end")


@query(f"""WITH {_SPANS}, md AS (SELECT k, count(*) AS n, median(s) AS s, median(e) AS e FROM rw WHERE e > s GROUP BY 1) SELECT pw.k, NOT coalesce(n = 12 AND k % 5 - 1 >= 0 AND abs(s - 17) <= k % 5 - 1 AND abs(e - 217) <= k % 5 - 1, FALSE) AS disagrees FROM pw LEFT JOIN md USING (k)""")
def global_timing_disagrees(spark, d):
    pages, rows, pixels = _twelve(spark, d)
    own = pages.selectExpr("k", "17 AS start", "217 AS end", "k % 5 - 1 AS tolerance")
    return ranges.disagrees(ranges.row_spans(pixels, rows.drop("pixels_per_mm"), pages, ["k"]), own, ["k"], "edges")
