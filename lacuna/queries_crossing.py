"""Paths that cross row bands, by unrolled dynamic programming in their oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import grouped
from lacuna.queries import query
from lacuna.sources import views

# A panel is an embedding as eight columns of eight rows, the first of them row 10 of the image; home is row 13.5.
_COLUMNS, _ROWS, _START, _HOME, _SPACING = 8, 8, 10, 13.5, 3.0
_REWARD, _RADIUS, _EXCURSION = 0.3, 2, 4.0
_INK = f"""ik AS (SELECT vec_id AS panel, x, r, abs(embedding[x * {_ROWS} + r + 1])::DOUBLE - floor(abs(embedding[x * {_ROWS} + r + 1])::DOUBLE) AS e FROM embeddings, (SELECT unnest(range({_COLUMNS})) AS x), (SELECT unnest(range({_ROWS})) AS r)),
cl AS (SELECT panel, x, list(e ORDER BY r) AS es FROM ik GROUP BY 1, 2),
rn AS (SELECT panel, x, min(r) AS first, max(r) AS last, count(*) AS size, arg_max(r, (e, -r)) AS top FROM (SELECT *, r - row_number() OVER (PARTITION BY panel, x ORDER BY r) AS island FROM ik WHERE e >= 0.28) GROUP BY panel, x, island),
st AS (SELECT DISTINCT panel, x, r FROM (SELECT panel, x, unnest([first, last, top] || CASE WHEN size >= 6 THEN [first + size // 3, first + size * 2 // 3] ELSE [] END) AS r FROM rn UNION ALL SELECT panel, x, arg_max(r, (e, -r)) FROM ik GROUP BY 1, 2 UNION ALL SELECT panel, x, CAST(round_even({_HOME}, 0) AS BIGINT) - {_START} FROM cl)),
sc AS (SELECT panel, x, r, es, 5 * (1 - es[r + 1]) + 4 * pow((r + {_START} - {_HOME}) / {_SPACING}, 2) AS plain, abs((r + {_START} - {_HOME}) / {_SPACING}::DOUBLE) AS away, panel % {_COLUMNS} AS anchor FROM st JOIN cl USING (panel, x)),
lc AS (SELECT *, plain - CASE WHEN abs(x - anchor) <= {_RADIUS} THEN {_EXCURSION}::DOUBLE * (1 - abs(x - anchor) / {_RADIUS + 1.0}::DOUBLE) * away ELSE 0 END AS c FROM sc)"""
_MOVE = "p.c + 0.0025::DOUBLE * abs(l.r - p.r) + 0.000018::DOUBLE * (l.r - p.r) * (l.r - p.r) - CASE WHEN len(list_filter(l.es[least(l.r, p.r) + 1 : greatest(l.r, p.r) + 1], lambda e: e < 0.24)) <= greatest(2, floor((abs(l.r - p.r) + 1) * 0.08)) THEN {reward} * abs(l.r - p.r) ELSE 0 END"


def _unrolled(cost: str, reward: float) -> str:
    move = _MOVE.format(reward=f"{reward}::DOUBLE")
    steps = [f"s0 AS (SELECT panel, r, {cost} AS c, [r] AS path FROM lc WHERE x = 0)"]
    steps += [f"s{k} AS (SELECT l.panel, l.r, min({move}) + any_value(l.{cost}) AS c, arg_min(p.path, {move}) || [l.r] AS path FROM lc l JOIN s{k - 1} p ON p.panel = l.panel WHERE l.x = {k} GROUP BY 1, 2)" for k in range(1, _COLUMNS)]
    return f"WITH {_INK}, {', '.join(steps)}, b AS (SELECT panel, arg_min(path, c) AS path FROM s{_COLUMNS - 1} GROUP BY 1) SELECT panel, CAST(generate_subscripts(path, 1) - 1 AS INT) AS x, CAST(unnest(path) + {_START} AS INT) AS y FROM b"


def _panels(spark, d):
    e = views.read(spark, d, "embeddings").select(F.col("vec_id").alias("panel"), F.transform("embedding", lambda v: F.abs(v).cast("double") - F.floor(F.abs(v).cast("double"))).alias("ink"))
    each = e.select("panel", "ink", F.explode(F.sequence(F.lit(0), F.lit(_COLUMNS - 1))).alias("x"))
    return each.select("panel", "x", F.lit(_START).alias("y_start"), F.lit(_HOME).alias("row_center"), F.lit(_SPACING).alias("row_spacing"), F.slice("ink", F.col("x") * _ROWS + 1, F.lit(_ROWS)).alias("evidence"))


@query(_unrolled("plain", 0.0))
def crossing_paths(spark, d):
    return grouped.crossings(_panels(spark, d))


@query(_unrolled("c", _REWARD))
def crossing_event_paths(spark, d):
    """With an event in each panel and a reward for moves along connected ink."""
    p = _panels(spark, d).withColumns({"anchor": F.col("x") == F.col("panel") % _COLUMNS, "reference": F.lit(None).cast("int")})
    return grouped.crossings(p, reward=_REWARD, radius=_RADIUS, excursion=_EXCURSION)
