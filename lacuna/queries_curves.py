"""Queries on curves over domains and on label grids, with their oracles."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lacuna.functions import curves
from lacuna.operators import domains, labels
from lacuna.plans import policy
from lacuna.queries import query
from lacuna.sources import views

_ROOTS = "CASE WHEN a = 0 THEN CASE WHEN b = 0 THEN []::DOUBLE[] ELSE [-c / b] END WHEN b * b - 4 * a * c < 0 THEN []::DOUBLE[] WHEN b * b - 4 * a * c = 0 THEN [-b / (2 * a)] ELSE [(-0.5 * (b + CASE WHEN b < 0 THEN -1 ELSE 1 END * sqrt(b * b - 4 * a * c))) / a, c / (-0.5 * (b + CASE WHEN b < 0 THEN -1 ELSE 1 END * sqrt(b * b - 4 * a * c)))] END"


def _intervals(margins: str, keys: str) -> str:
    """CTEs from `margins` (keys, a, b, c) to iv (keys, lo, hi)."""
    return f"""ct AS (SELECT DISTINCT {keys}, t FROM (SELECT {keys}, unnest({_ROOTS} || [0.0::DOUBLE, 1.0::DOUBLE]) AS t FROM {margins}) WHERE t BETWEEN 0 AND 1),
pc AS (SELECT {keys}, t AS lo, lead(t) OVER (PARTITION BY {keys} ORDER BY t) AS hi FROM ct),
iv AS (SELECT {keys}, lo, hi FROM pc JOIN {margins} USING ({keys}) WHERE hi IS NOT NULL GROUP BY {keys}, lo, hi HAVING bool_and((a * ((lo + hi) / 2) + b) * ((lo + hi) / 2) + c >= 0))"""


@query(f"""WITH mg AS (SELECT l_orderkey AS run, (l_quantity - 25)::DOUBLE AS a, ((l_partkey % 61) - 30)::DOUBLE AS b, ((l_suppkey % 23) - 4 + l_linenumber)::DOUBLE AS c FROM lineitem), {_intervals("mg", "run")} SELECT run, round(lo, 9) AS lo, round(hi, 9) AS hi FROM iv""")
def positive_intervals(spark, d):
    """Where the margins of an order's lines are non-negative together."""
    li = views.read(spark, d, "lineitem")
    margin = F.struct((F.col("l_quantity") - 25).cast("double").alias("a"), ((F.col("l_partkey") % 61) - 30).cast("double").alias("b"), ((F.col("l_suppkey") % 23) - 4 + F.col("l_linenumber")).cast("double").alias("c"))
    runs = li.groupBy(F.col("l_orderkey").alias("run")).agg(F.collect_list(margin).alias("margins"))
    return runs.select("run", F.explode(curves.positive_intervals(F.col("margins"))).alias("i")).select("run", F.round("i.lo", 9).alias("lo"), F.round("i.hi", 9).alias("hi"))


# A page (nation) has trapezoids side by side, one of twelve missing; suppliers' and customers' curves run over them.
ROWS_IN_PART = 20_000  # paths: each becomes a row for every cell and domain that it meets
_PATHS = "CAST(id % 7 - 3 AS DOUBLE) * 2 AS xa, CAST(id % 31 AS DOUBLE) - 10 AS xb, CAST(id % 100 AS DOUBLE) + 5.25 AS xc, CAST(id % 11 - 5 AS DOUBLE) * 1.5 AS ydy, CAST(id % 13 AS DOUBLE) * 1.25 + 1.5 AS y0"
_DOMAIN = "10.0D * k AS left, 10.0D * (k + 1) AS right, CAST((k + page) % 3 AS DOUBLE) AS u0, CAST((k + page + 1) % 3 AS DOUBLE) AS u1, 18.0D + (k * page) % 4 AS v0, 18.0D + ((k + 1) * page) % 4 AS v1"


@query(f"""WITH pt AS (SELECT c_nationkey AS page, c_custkey AS id FROM customer), pa AS (SELECT page, id, {_PATHS} FROM pt),
dm AS (SELECT page, k AS domain, {_DOMAIN.replace('D *', '::DOUBLE *').replace('D +', '::DOUBLE +').replace('AS left', 'AS lft').replace('AS right', 'AS rgt')} FROM (SELECT n_nationkey AS page, unnest(range(12)) AS k FROM nation) WHERE k <> page % 12),
sl AS (SELECT *, (u1 - u0) / (rgt - lft) AS us, (v1 - v0) / (rgt - lft) AS vs FROM dm),
ms AS (SELECT page, domain, unnest([{{'ax': 1.0::DOUBLE, 'ay': 0.0::DOUBLE, 'k': -lft}}, {{'ax': -1.0, 'ay': 0.0, 'k': rgt}}, {{'ax': -us, 'ay': 1.0, 'k': us * lft - u0}}, {{'ax': vs, 'ay': -1.0, 'k': v0 - vs * lft}}], recursive := true) FROM sl),
mg AS (SELECT page, id, domain, ax * xa AS a, ax * xb + ay * ydy AS b, ax * xc + ay * y0 + k AS c FROM pa JOIN ms USING (page)), {_intervals("mg", "page, id, domain")},
rn AS (SELECT page, id, lo, hi, coalesce(max(hi) OVER (PARTITION BY page, id ORDER BY lo, hi, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM iv),
cv AS (SELECT page, id, bool_and(lo <= before + 1e-12) AND max(hi) >= 1 - 1e-12 AS covered, count(*) AS pieces, round(sum(hi - lo), 8) AS extent FROM rn GROUP BY 1, 2)
SELECT page, id, coalesce(covered, FALSE) AS covered, coalesce(pieces, 0) AS pieces, coalesce(extent, 0) AS extent FROM pt LEFT JOIN cv USING (page, id)""")
def curve_connections(spark, d):
    paths = views.dealt(views.read(spark, d, "customer").selectExpr("c_nationkey AS page", "c_custkey AS id"), ROWS_IN_PART, "page", "id").selectExpr("page", "id", *_PATHS.split(", "))
    cells = views.read(spark, d, "nation").selectExpr("n_nationkey AS page", "explode(sequence(0, 11)) AS k").where("k <> page % 12").selectExpr("page", "CAST(k AS BIGINT) AS domain", *_DOMAIN.split(", "))
    cells = cells.selectExpr("*", "(u1 - u0) / (right - left) AS us", "(v1 - v0) / (right - left) AS vs")
    margin = lambda ax, ay, k: F.struct(F.expr(ax).alias("ax"), F.expr(ay).alias("ay"), F.expr(k).alias("k"))
    margins = F.array(margin("1.0D", "0.0D", "-left"), margin("-1.0D", "0.0D", "right"), margin("-us", "1.0D", "us * left - u0"), margin("vs", "-1.0D", "v0 - vs * left"))
    mesh = cells.select("page", "domain", "left", F.least("u0", "u1").alias("top"), "right", F.greatest("v0", "v1").alias("bottom"), margins.alias("margins"))
    found = domains.connections(paths, mesh, ["page"], 10.0)
    return found.select("page", "id", "covered", F.size("intervals").cast("long").alias("pieces"), F.round(F.aggregate("intervals", F.lit(0.0), lambda s, i: s + i["hi"] - i["lo"]), 8).alias("extent"))


# label grids: a supplier's page has twelve labels; some are missing, moved, or all in one row

_LABEL = "40.0D + 3.0D * (k % 3) + 200.0D * column + 1.5D * row * ((k % 5) - 2) + 0.25D * row * column * (k % 4) + CASE WHEN k % 9 = 4 AND lead = 'V2' THEN 30 ELSE 0 END + ((k * 7 + row * 5 + column * 3) % 11 - 5) / 4.0D AS x, 90.0D + CASE WHEN k % 10 = 3 THEN 400.0D ELSE 150.0D END * row + 2.0D * column * ((k % 4) - 1) + 0.5D * row * column + ((k * 5 + row + column * 7) % 9 - 4) / 4.0D AS y"
_THERE = "CASE k % 8 WHEN 0 THEN row = 0 WHEN 1 THEN column = 2 WHEN 2 THEN row = column WHEN 3 THEN lead IN ('I', 'V6', 'III', 'V4') WHEN 4 THEN (row + column) % 2 = 0 WHEN 5 THEN FALSE ELSE (k + row * 4 + column) % 7 > 0 END"
_PAGE_OF = "900 + k % 50 AS width, 700 AS height, 12.0D + k % 4 AS font"
_sql = lambda e: re.sub(r"\b(row|column)\b", r'"\1"', re.sub(r"(\d)D\b", r"\1::DOUBLE", e))
_NAMED = ", ".join(f"({r}, {k}, '{n}')" for r, line in enumerate(policy.LABEL_ROWS) for k, n in enumerate(line))
_SUMS = ", ".join([f"sum({a} * {b})::DOUBLE AS g{i}{j}" for i, a in enumerate(("1", "r", "c", "r * c")) for j, b in enumerate(("1", "r", "c", "r * c")) if i <= j] + [f"sum({a} * {v})::DOUBLE AS {v}{i}" for v in ("x", "y") for i, a in enumerate(("1", "r", "c", "r * c"))])


def _gauss() -> str:
    """CTEs e0 to e3 of Gauss-Jordan steps over nm (k and the sums), for pages whose labels span the grid, to bt (k, bx, by)."""
    cell = lambda i, j: f"g{min(i, j)}{max(i, j)}" if j < 4 else f"{'xy'[j - 4]}{i}"
    steps = [f"e0 AS (SELECT k, {', '.join(f'{cell(i, j)} AS m{i}{j}' for i in range(4) for j in range(6))} FROM nm)"]
    for s in range(4):
        rows = ", ".join(f"m{s}{j} / m{s}{s} AS m{s}{j}" if i == s else f"m{i}{j} - m{i}{s} * m{s}{j} / m{s}{s} AS m{i}{j}" for i in range(4) for j in range(6))
        steps.append(f"e{s + 1} AS (SELECT k, {rows} FROM e{s})")
    return ", ".join(steps) + ", bt AS (SELECT k, " + ", ".join(f"m{i}4 AS bx{i}, m{i}5 AS by{i}" for i in range(4)) + " FROM e4)"


_CORNER = lambda r, k: {"column_spacing": f"bx2 + {r} * bx3 > 0.12 * width AND bx2 + {r} * bx3 < 0.3 * width", "row_spacing": f"by1 + {k} * by3 > 0.09 * height AND by1 + {k} * by3 < 0.3 * height", "horizontal_skew": f"abs(bx1 + {k} * bx3) < (bx2 + {r} * bx3) * 0.06", "vertical_skew": f"abs(by2 + {r} * by3) < (by1 + {k} * by3) * 0.06", "font_height": f"font > 0.02 * (by1 + {k} * by3) AND font < 0.18 * (by1 + {k} * by3)", "jacobian": f"(bx2 + {r} * bx3) * (by1 + {k} * by3) - (bx1 + {k} * bx3) * (by2 + {r} * by3) > 0"}
_CHECKS = ", ".join(f"CASE WHEN NOT ({ok}) THEN '{name}:{r}:{k}' END" for r in (0, 3) for k in (0, 3) for name, ok in _CORNER(r, k).items())
_LABEL_SQL = f"""pg AS (SELECT s_suppkey AS k, {_sql(_PAGE_OF).replace("k %", "s_suppkey %")} FROM supplier), nl AS (SELECT * FROM (VALUES {_NAMED}) AS v("row", "column", lead)),
pt AS (SELECT k, lead, "row" AS r, "column" AS c, {_sql(_LABEL)} FROM pg, nl WHERE {_sql(_THERE)}),
nm AS (SELECT k, {_SUMS} FROM pt WHERE k % 8 NOT IN (0, 1, 2, 5) GROUP BY 1), {_gauss()},
al AS (SELECT pg.k, width, height, font, bt.* EXCLUDE (k) FROM pg JOIN bt USING (k)),
st AS (SELECT k, list(lead ORDER BY lead) AS strays FROM (SELECT al.k, lead FROM al JOIN pt USING (k) WHERE NOT (abs(bx0 + bx1 * r + bx2 * c + bx3 * r * c - x) < 0.04 * (bx2 + r * bx3) AND abs(by0 + by1 * r + by2 * c + by3 * r * c - y) < greatest(0.6 * font, 0.04 * (by1 + c * by3)))) GROUP BY 1),
fl AS (SELECT al.*, list_filter([{_CHECKS}], lambda f: f IS NOT NULL) AS failed, coalesce(strays, []) AS strays FROM al LEFT JOIN st USING (k))"""


def _fits(spark, d):
    pages = views.read(spark, d, "supplier").selectExpr("s_suppkey AS k").selectExpr("k", *_PAGE_OF.split(", "))
    named = F.explode(F.array(*(F.struct(F.lit(r).alias("row"), F.lit(k).alias("column"), F.lit(n).alias("lead")) for r, line in enumerate(policy.LABEL_ROWS) for k, n in enumerate(line))))
    points = pages.select("k", named.alias("n")).select("k", "n.*").where(_THERE).selectExpr("k", "lead", *_LABEL.split(", "))
    return labels.fit(points, pages, ["k"])


@query(f"""WITH {_LABEL_SQL} SELECT pg.k, bx0 IS NOT NULL AS solved, CASE WHEN bx0 IS NOT NULL THEN 4 WHEN pg.k % 8 = 5 THEN 0 WHEN pg.k % 8 = 1 THEN 2 WHEN pg.k % 8 = 0 THEN 2 ELSE 3 END AS rank, round(bx0, 6) AS x0, round(bx3, 6) AS x3, round(by1, 6) AS y1, array_to_string(failed, ',') AS failed, array_to_string(strays, ',') AS strays, coalesce(len(failed) = 0 AND len(strays) = 0, FALSE) AS passed, round(by1 + 1.5 * by3, 6) AS mean_row, round(bx2 + 1.5 * bx3, 6) AS mean_column FROM pg LEFT JOIN fl USING (k)""")
def label_fits(spark, d):
    f = _fits(spark, d)
    return f.select("k", F.col("x_fit").isNotNull().alias("solved"), F.col("rank").cast("long").alias("rank"), F.round(F.col("x_fit")[0], 6).alias("x0"), F.round(F.col("x_fit")[3], 6).alias("x3"), F.round(F.col("y_fit")[1], 6).alias("y1"), F.array_join("failed", ",").alias("failed"), F.array_join("strays", ",").alias("strays"), "passed", F.round("mean_row", 6).alias("mean_row"), F.round("mean_column", 6).alias("mean_column"))


_RHYTHM = "52.0D + k % 40 AS rhythm_x, 520.0D + (k % 13) * 6 AS rhythm_y"


@query(f"""WITH {_LABEL_SQL}, rh AS (SELECT fl.*, {_sql(_RHYTHM)} FROM fl), ok AS (SELECT *, abs(rhythm_x - bx0 - 3 * bx1) < 0.12 * (bx2 + 3 * bx3) AND abs(rhythm_y - by0 - 3 * by1) < 0.25 * by1 AS good FROM rh),
bx AS (SELECT k, r, c, lead, width, height, font, CASE WHEN r = 3 THEN rhythm_x ELSE bx0 + bx1 * r + bx2 * c + bx3 * r * c END AS x, CASE WHEN r = 3 THEN rhythm_y ELSE by0 + by1 * r + by2 * c + by3 * r * c END AS y FROM ok, (SELECT "row" AS r, "column" AS c, lead FROM nl UNION ALL SELECT 3, 0, 'II') WHERE good),
rd AS (SELECT *, round_even(round(x - 0.65 * font, 9), 0) AS l, round_even(round(y - 0.6 * font, 9), 0) AS t, round_even(round(x + 3.4 * font, 9), 0) AS e, round_even(round(y + 0.6 * font, 9), 0) AS b FROM bx)
SELECT k, r AS "row", c AS "column", lead, CAST(l AS INT) AS "left", CAST(t AS INT) AS top, CAST(e AS INT) AS "right", CAST(b AS INT) AS bottom FROM rd QUALIFY bool_and(l >= 0 AND l < e AND e <= width AND t >= 0 AND t < b AND b <= height) OVER (PARTITION BY k)""")
def label_slots(spark, d):
    rhythm = views.read(spark, d, "supplier").selectExpr("s_suppkey AS k").selectExpr("k", *_RHYTHM.split(", "))
    return labels.slots(labels.rhythm_check(_fits(spark, d), rhythm, ["k"]).where("rhythm_passed"), ["k"])
