"""Queries on evidence bundles and on the intake of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.queries import V1, query
from lacuna.sources import bundles, signals, views
from lacuna.streaming import intakes


@query(f"""WITH {V1}, s AS (SELECT series, sample, CASE WHEN (series + sample) % 13 <> 5 THEN value * 100 END AS uv, CASE WHEN sample % 9 = 4 THEN '' WHEN sample % 9 = 5 THEN NULL ELSE 'say "' || sample || '",' || chr(10) || 'é' END AS note FROM v1)
SELECT series % 20 AS lead, count(*) AS n, count(uv) AS finite, round(sum(uv), 5) AS total, count(note) AS notes, count(*) FILTER (note = '') AS empty, sum(length(note))::BIGINT AS chars, TRUE AS complete, TRUE AS same_rows FROM s GROUP BY 1""")
def published_bundle(spark, d):
    """Signals written as a bundle and read back: what each lead has, and that manifest and rows agree."""
    c = F.col
    note = F.when(c("sample") % 9 == 4, "").when(c("sample") % 9 == 5, None).otherwise(F.concat(F.lit('say "'), c("sample").cast("string"), F.lit('",\né')))
    signal = views.regular_series(spark, d).select("series", "sample", F.when((c("series") + c("sample")) % 13 != 5, c("value") * 100).alias("uv"), note.alias("note"))
    path = signals.scratch(spark, "bundle")
    bundles.write_bundle(signal.repartitionByRange("series").sortWithinPartitions("series", "sample"), path)
    back, listed = bundles.read_bundle(spark, path), bundles.manifest(spark, path)
    said = listed.agg(F.sum("rows").alias("said"), F.min(F.length("sha256") == 64).alias("complete"))
    total = back.agg(F.count("*").alias("all_rows"))
    per = back.groupBy((c("series") % 20).alias("lead")).agg(F.count("*").alias("n"), F.count("uv").alias("finite"), F.round(F.sum("uv"), 5).alias("total"), F.count("note").alias("notes"), F.count_if(c("note") == "").alias("empty"), F.sum(F.length("note")).alias("chars"))
    checks = total.crossJoin(said).select("complete", (c("said") == c("all_rows")).alias("same_rows"))  # one row
    return per.crossJoin(F.broadcast(checks))


_KIND = "CASE event_id % 7 WHEN 0 THEN 'staged' WHEN 1 THEN 'committed' WHEN 2 THEN 'archived' WHEN 3 THEN NULL ELSE 'heartbeat' END"


@query(f"""WITH e AS (SELECT user_id AS run, ts, coalesce({_KIND}, 'heartbeat') AS kind, event_id % 3 <> 0 AS valid FROM events), o AS (SELECT *, list_position(['staged', 'committed', 'heartbeat', 'archived'], kind) AS place FROM e),
s AS (SELECT *, lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 18 HOURS OR lag(kind) OVER w = 'archived' AS starts FROM o WINDOW w AS (PARTITION BY run ORDER BY ts, place, valid)), n AS (SELECT *, sum(starts::INT) OVER (PARTITION BY run ORDER BY ts, place, valid ROWS UNBOUNDED PRECEDING) AS intake FROM s),
g AS (SELECT run, intake, min(ts) AS opened, max(ts) AS last, count(*) AS events, bool_or(kind = 'archived') AS archived, arg_max(valid, (ts, place, valid)) FILTER (kind IN ('staged', 'committed')) AS valid FROM n GROUP BY 1, 2)
SELECT run, epoch_us(opened) AS opened, epoch_us(last) AS last, events, CASE WHEN archived THEN 'archived' WHEN (SELECT max(ts) FROM e) < last + INTERVAL 18 HOURS THEN 'deferred' WHEN coalesce(valid, FALSE) THEN 'recovered' ELSE 'failed' END AS outcome FROM g""")
def intake_outcomes(spark, d):
    """What becomes of every intake of a log of events."""
    e = views.read(spark, d, "events").select(F.col("user_id").alias("run"), "ts", F.expr(_KIND).alias("kind"), (F.col("event_id") % 3 != 0).alias("valid"))
    found = intakes.outcomes(e, "18 hours")
    return found.withColumns({n: F.unix_micros(n) for n in ("opened", "last")})
