"""Queries on the support of traced paths by source ink: embeddings as pages of eight by eight pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import source_support
from lacuna.queries import query
from lacuna.sources import views

_SHADE = "CAST(floor((abs(v) - floor(abs(v))) * 255) AS INT)"
_REGION, _TEXT, _GRID, _UNCLEAR = "y BETWEEN 1 AND 6", "(x * y + page) % 9 = 0", "(x + y * 3 + page) % 13 = 0", "(x + 2 * y + page) % 11 = 0"
_BLUE = "CASE WHEN (x + page) % 10 = 0 THEN 60 ELSE 0 END"
_X, _Y = "CASE WHEN (page + i) % 7 = 0 THEN NULL ELSE i * 1.0 END", "CASE WHEN (page + i) % 7 = 0 THEN NULL ELSE (page * 3 + i * 5) % 8 + 0.5 END"
_TOLERANCE = 1.5
ROWS_IN_PART = 2_000  # pages: each becomes its pixels

_SUPPORT = f"""px AS (SELECT vec_id AS page, i % 8 AS x, i // 8 AS y, embedding[i + 1]::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS i)),
ik AS (SELECT *, {_SHADE} < 170 AND {_SHADE} + {_BLUE} < 170 AND {_BLUE} < 45 AS dark, {_REGION} AS region, {_TEXT} OR {_GRID} AS excluded, {_UNCLEAR} AS unclear FROM px), ev AS (SELECT page, x, y FROM ik WHERE dark AND region AND NOT excluded AND NOT unclear),
pt AS (SELECT page, i, ({_X})::DOUBLE AS x, ({_Y})::DOUBLE AS y FROM (SELECT vec_id AS page, unnest(range(9)) AS i FROM embeddings)),
pp AS (SELECT page, i, x IS NOT NULL AS valid, CAST(round_even(x, 0) AS BIGINT) AS px, CAST(round_even(y, 0) AS BIGINT) AS py, coalesce(round_even(x, 0) < 8 AND round_even(y, 0) < 8, FALSE) AS inside FROM pt),
ds AS (SELECT pp.page, i, min(sqrt((ev.x - px) ** 2 + (ev.y - py) ** 2)) AS far FROM pp JOIN ev ON ev.page = pp.page WHERE inside GROUP BY 1, 2),
jd AS (SELECT pp.*, CASE WHEN far <= {_TOLERANCE} THEN far END AS distance, inside AND coalesce(region, FALSE) AS in_region, inside AND coalesce(excluded, FALSE) AS on_mask, inside AND coalesce(unclear, FALSE) AS hazy FROM pp LEFT JOIN ds USING (page, i) LEFT JOIN ik ON ik.page = pp.page AND ik.x = px AND ik.y = py),
ju AS (SELECT *, valid AND NOT hazy AS assessable, valid AND NOT hazy AND (distance IS NULL OR NOT in_region OR on_mask) AS unsupported FROM jd),
sg AS (SELECT page, px, py, CASE WHEN lag(inside) OVER o THEN lag(px) OVER o ELSE px END AS sx, CASE WHEN lag(inside) OVER o THEN lag(py) OVER o ELSE py END AS sy, inside FROM pp WINDOW o AS (PARTITION BY page ORDER BY i)),
ln AS (SELECT DISTINCT page, CAST(floor(sx + (px - sx) * t / greatest(n, 1) + 0.5) AS BIGINT) AS x, CAST(floor(sy + (py - sy) * t / greatest(n, 1) + 0.5) AS BIGINT) AS y FROM (SELECT *, greatest(abs(px - sx), abs(py - sy)) AS n, unnest(range(greatest(abs(px - sx), abs(py - sy)) + 1)) AS t FROM sg WHERE inside)),
om AS (SELECT ev.*, NOT EXISTS (SELECT 1 FROM ln WHERE ln.page = ev.page AND (ln.x - ev.x) ** 2 + (ln.y - ev.y) ** 2 <= {_TOLERANCE} * {_TOLERANCE}) AS omitted FROM ev)"""


def _source(spark, d):
    dealt = views.dealt(views.read(spark, d, "embeddings").select(F.col("vec_id").alias("page"), "embedding"), ROWS_IN_PART, "page")
    e = dealt.select("page", F.posexplode("embedding").alias("i", "v")).selectExpr("page", "i % 8 AS x", "i DIV 8 AS y", "CAST(v AS DOUBLE) AS v")
    masks = f"filter(array(CASE WHEN {_TEXT} THEN 'text' END, CASE WHEN {_GRID} THEN 'grid' END), m -> m IS NOT NULL)"
    pixels = e.selectExpr("page", "CAST(x AS BIGINT) AS x", "CAST(y AS BIGINT) AS y", f"{_SHADE} AS red", f"{_SHADE} AS green", f"{_SHADE} + {_BLUE} AS blue", f"{_REGION} AS region", f"{masks} AS excluded", f"{_UNCLEAR} AS ambiguous")
    own = dealt.select("page")
    points = own.selectExpr("page", "explode(sequence(0, 8)) AS i").selectExpr("page", "i", f"CAST({_X} AS DOUBLE) AS x", f"CAST({_Y} AS DOUBLE) AS y")
    return source_support.verify(pixels, points, own.selectExpr("page", "8 AS width", "8 AS height"), ["page"], _TOLERANCE, ["text", "grid"])


@query(f"WITH {_SUPPORT} SELECT page, CAST(i AS INT) AS i, valid, round(distance, 9) AS distance, in_region, on_mask, hazy AS unclear, assessable, unsupported FROM ju")
def supported_points(spark, d):
    return _source(spark, d)[0].withColumn("distance", F.round("distance", 9))


@query(f"""WITH {_SUPPORT}, a AS (SELECT page, count(*) FILTER (assessable) AS assessable, count(*) FILTER (valid AND hazy) AS ambiguous, count(*) FILTER (unsupported) AS unsupported, count(*) FILTER (valid AND NOT in_region) AS outside, count(*) FILTER (on_mask) AS on_mask FROM ju GROUP BY 1), b AS (SELECT page, count(*) AS ink, count(*) FILTER (omitted) AS omitted FROM om GROUP BY 1)
SELECT page, assessable, ambiguous, unsupported, round(unsupported / nullif(assessable, 0), 9) AS unsupported_fraction, coalesce(ink, 0) AS ink, coalesce(omitted, 0) AS omitted, round(omitted / nullif(ink, 0), 9) AS omitted_fraction, concat_ws(',', CASE WHEN unsupported > 0 THEN 'trace_without_visible_waveform_support' END, CASE WHEN omitted > 0 THEN 'visible_source_structure_omitted' END, CASE WHEN outside > 0 THEN 'trace_outside_lead_region' END, CASE WHEN on_mask > 0 THEN 'trace_follows_excluded_nonwaveform_marks' END, CASE WHEN ambiguous > 0 THEN 'ambiguous_source_overlap' END) AS reasons, FALSE AS complete FROM a LEFT JOIN b USING (page)""")
def source_verification(spark, d):
    return _source(spark, d)[2].withColumns({"reasons": F.array_join("reasons", ","), "unsupported_fraction": F.round("unsupported_fraction", 9), "omitted_fraction": F.round("omitted_fraction", 9)})


@query(f"""WITH RECURSIVE {_SUPPORT}, eg AS (SELECT a.page, a.y * 8 + a.x AS a, b.y * 8 + b.x AS b FROM ev a JOIN ev b ON a.page = b.page AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1),
rc AS (SELECT page, a, b FROM eg UNION SELECT rc.page, rc.a, eg.b FROM rc JOIN eg ON eg.page = rc.page AND eg.a = rc.b), cp AS (SELECT page, a, min(b) AS first FROM rc GROUP BY 1, 2)
SELECT page, dense_rank() OVER (PARTITION BY page ORDER BY first) - 1 AS component, count(*) AS pixels, count(*) FILTER (omitted) AS omitted FROM cp JOIN om ON om.page = cp.page AND om.y * 8 + om.x = cp.a GROUP BY page, first""".replace("GROUP BY page, first", "GROUP BY cp.page, first").replace("SELECT page, dense_rank() OVER (PARTITION BY page", "SELECT cp.page, dense_rank() OVER (PARTITION BY cp.page"))
def ink_components(spark, d):
    return source_support.components(_source(spark, d)[1], ["page"])
