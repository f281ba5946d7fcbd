"""Queries on aligned leads, with the policy's whole search in their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.operators import alignment, quality
from lacuna.plans import policy
from lacuna.queries import query
from lacuna.sources import views

#: Vectors of a run, whose candidates compete within a label.
RUN = 50

_SCALES = ", ".join(f"({k}, {s}::DOUBLE)" for k, s in enumerate(policy.ALIGN_SCALES))
_R = policy.ALIGN_RADIUS


def _search(pairs: str, keys: str) -> str:
    """CTEs from `pairs` (keys, a, b, va, vb) to `al` (keys, a, b, scale, shift, off, rmse): every hypothesis, the best first one."""
    return f"""hy AS (SELECT k * {2 * _R + 1} + shift + {_R} AS h, scale, shift FROM (VALUES {_SCALES}) AS s(k, scale), (SELECT unnest(range({-_R}, {_R + 1})) AS shift)),
ds AS (SELECT {keys}, a, b, h, scale, shift, len(va) AS n, list_filter(list_transform(range(len(va)), lambda i: CASE WHEN floor((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift) >= 0 AND ceil((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift) < len(vb)
THEN vb[CAST(floor((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift) AS INT) + 1] * (1 - ((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift - floor((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift))) + vb[CAST(ceil((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift) AS INT) + 1] * ((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift - floor((len(va) - 1) / 2 + (i - (len(va) - 1) / 2) * scale + shift)) - va[i + 1] END), lambda x: x IS NOT NULL) AS d FROM {pairs}, hy),
ms AS (SELECT *, list_median(d) AS off FROM ds WHERE len(d) >= least(n, greatest({policy.MIN_SAMPLES}, ceil(n * {policy.MIN_OVERLAP}::DOUBLE)))),
es AS (SELECT {keys}, a, b, h, scale, shift, off, list_sort(list_transform(d, lambda x: abs(x - off)))[1 : CAST(ceil(len(d) * {policy.TRIM_KEEP}::DOUBLE) AS INT)] AS r FROM ms),
rs AS (SELECT *, sqrt(list_sum(list_transform(r, lambda x: x * x)) / len(r)) AS rmse FROM es),
bs AS (SELECT * FROM rs QUALIFY row_number() OVER (PARTITION BY {keys}, a, b ORDER BY rmse, h) = 1),
al AS (SELECT p.* EXCLUDE (va, vb), scale, shift, off, rmse FROM {pairs} AS p LEFT JOIN bs USING ({keys}, a, b))"""


@query(f"""WITH vp AS (SELECT x.vec_id // {RUN} AS run, x.label, x.vec_id AS a, y.vec_id AS b, x.embedding::DOUBLE[] AS va, y.embedding::DOUBLE[] AS vb FROM embeddings x JOIN embeddings y ON x.vec_id // {RUN} = y.vec_id // {RUN} AND x.label = y.label AND x.vec_id < y.vec_id),
{_search("vp", "run, label")} SELECT a, b, scale, CAST(shift AS INT) AS shift, round(off, 9) AS "offset", round(rmse, 9) AS rmse FROM al""")
def aligned_series(spark, d):
    """The alignment search of the policy over all pairs of a run's candidates of one label: a, b (a < b), scale, shift, offset, rmse."""
    e = views.read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / RUN).alias("run"), "label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"))
    return alignment.pair_table(e, ["run", "label"], "id").select("a", "b", "scale", "shift", F.round("offset", 9).alias("offset"), F.round("rmse", 9).alias("rmse"))


#: Users pooled to a run, so that most days have a value of each candidate.
USERS = 10
#: About the median error of these tables, so that both outcomes occur.
TRUST_LIMIT = 24.0
LEADS = f"""v3 AS (SELECT user_id // {USERS} AS series, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS sample, event_type AS candidate, round(avg(value), 6) AS value FROM events GROUP BY 1, 2, 3), sp AS (SELECT series, min(sample) AS lo, max(sample) AS hi FROM v3 GROUP BY 1), id AS (SELECT DISTINCT series, candidate FROM v3 WHERE value IS NOT NULL),
ld AS (SELECT series, candidate, list(value ORDER BY sample) AS vs FROM (SELECT series, candidate, sample, value FROM id JOIN (SELECT series, unnest(range(lo, hi + 1)) AS sample FROM sp) USING (series) LEFT JOIN v3 USING (series, candidate, sample)) GROUP BY 1, 2),
cp AS (SELECT x.series, x.candidate AS a, y.candidate AS b, x.vs AS va, y.vs AS vb FROM ld x JOIN ld y ON x.series = y.series AND x.candidate < y.candidate), {_search("cp", "series")}, bw AS (SELECT series, a, b, rmse FROM al UNION ALL SELECT series, b, a, rmse FROM al)"""


def _aligned(spark, d):
    e = views.read(spark, d, "events").select(F.floor(F.col("user_id") / USERS).alias("series"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6) / 86400).cast("long").alias("sample"), F.col("event_type").alias("candidate"), "value")
    leads = alignment.dense(e.groupBy("series", "sample", "candidate").agg(F.round(F.avg("value"), 6).alias("value")), ["series"], "candidate")
    return leads, alignment.pair_table(leads, ["series"], "candidate")


@query(f"""WITH {LEADS} SELECT series, a, b, scale, CAST(shift AS INT) AS shift, round(off, 5) AS "offset", round(rmse, 5) AS rmse FROM al""")
def aligned_candidates(spark, d):
    _, pairs = _aligned(spark, d)
    return pairs.select("series", "a", "b", "scale", "shift", F.round("offset", 5).alias("offset"), F.round("rmse", 5).alias("rmse"))


@query(f"""WITH {LEADS} SELECT series, a AS candidate, coalesce(CAST(floor(round(quantile_cont(rmse, 0.5) * 25, 6) + 0.5) AS BIGINT), 0) AS penalty, count(rmse) AS compared FROM bw GROUP BY 1, 2""")
def aligned_penalty(spark, d):
    _, pairs = _aligned(spark, d)
    return alignment.penalties(pairs, ["series"])


@query(f"""WITH {LEADS} SELECT series, candidate FROM ld WHERE EXISTS (SELECT 1 FROM bw WHERE bw.series = ld.series AND bw.a = ld.candidate AND round(rmse, 6) <= {TRUST_LIMIT} AND (bw.a = 'click') <> (bw.b = 'click'))""")
def aligned_trust(spark, d):
    """Candidates that an independent one (click against the others) matches within the limit after alignment."""
    leads, pairs = _aligned(spark, d)
    return quality.trusted(leads.select("series", "candidate"), pairs.withColumn("rmse", F.round("rmse", 6)), ["series"], "candidate", (F.col("a") == "click") != (F.col("b") == "click"), TRUST_LIMIT)


@query(f"""WITH {LEADS}, fi AS (SELECT series, min(candidate) AS a FROM ld GROUP BY 1), ow AS (SELECT fi.series, a, unnest(range(len(vs))) AS place, unnest(vs) AS value FROM fi JOIN ld ON ld.series = fi.series AND ld.candidate = fi.a),
ap AS (SELECT al.series, al.a, off, x.vs AS vb, i AS place, (len(x.vs) - 1) / 2 + (i - (len(x.vs) - 1) / 2) * scale + shift AS p FROM al JOIN fi USING (series, a) JOIN ld x ON x.series = al.series AND x.candidate = al.b, LATERAL (SELECT unnest(range(len(x.vs))) AS i) WHERE rmse IS NOT NULL),
pv AS (SELECT series, a, place, CASE WHEN floor(p) >= 0 AND ceil(p) < len(vb) THEN vb[CAST(floor(p) AS INT) + 1] * (1 - (p - floor(p))) + vb[CAST(ceil(p) AS INT) + 1] * (p - floor(p)) END - off AS value FROM ap),
un AS (SELECT *, TRUE AS own FROM ow UNION ALL SELECT *, FALSE FROM pv), gr AS (SELECT series, a AS reference, place, count(value) AS candidates, max(value) - min(value) AS spread, bool_or(own AND value IS NOT NULL) AS held FROM un GROUP BY 1, 2, 3)
SELECT series, reference, CAST(place AS INT) AS place, candidates, round(spread, 3) AS spread, CASE WHEN NOT held THEN 'missing' WHEN spread > 75 THEN 'uncertain_candidate_disagreement' ELSE 'observed' END AS status FROM gr""")
def aligned_uncertainty(spark, d):
    leads, pairs = _aligned(spark, d)
    return alignment.spreads(leads, pairs, ["series"], "candidate").withColumn("spread", F.round("spread", 3))
