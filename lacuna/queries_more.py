"""More queries: candidate rules, calibration, time windows, lineage weights, capture checks, intake contracts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lacuna.functions import gates, text
from lacuna.operators import evidence, islands
from lacuna.plans import policy
from lacuna.queries import V1, V2, V3, V7, query
from lacuna.sources import views

# candidate rules


@query(f"""WITH {V7} SELECT run, candidate, CASE WHEN kind = 'R' THEN 'capability' WHEN layout = 'O' AND warnings > 8 THEN 'native_timing' WHEN missing > 7 THEN 'preprocessing' WHEN crop = 6 THEN 'artifact' END AS reason FROM v7""")
def ineligibility(spark, d):
    p = views.pools(spark, d)
    why = gates.first_reason(("capability", F.col("kind") == "R"), ("native_timing", (F.col("layout") == "O") & (F.col("warnings") > 8)), ("preprocessing", F.col("missing") > 7), ("artifact", F.col("crop") == 6))
    return p.select("run", "candidate", why.alias("reason"))


@query("""SELECT p_partkey, CASE WHEN starts_with(p_type, 'STANDARD') THEN 'standard_12x1' WHEN starts_with(p_type, 'SMALL') THEN 'standard_6x2' WHEN starts_with(p_type, 'MEDIUM') THEN 'standard_3x4' ELSE p_type END AS layout, p_size < 10 AS low_resolution, CASE WHEN p_size < 5 THEN 'screen' WHEN p_size < 10 THEN 'low-resolution' WHEN p_retailprice > 1500 THEN 'blur' ELSE 'clean' END AS context FROM part""")
def layout_names_and_contexts(spark, d):
    p = views.read(spark, d, "part")
    layout = F.coalesce(gates.first_reason(*((f"standard_{k}", F.col("p_type").startswith(v)) for k, v in (("12x1", "STANDARD"), ("6x2", "SMALL"), ("3x4", "MEDIUM")))), F.col("p_type"))
    context = F.coalesce(gates.first_reason(("screen", F.col("p_size") < 5), ("low-resolution", F.col("p_size") < 10), ("blur", F.col("p_retailprice") > 1500)), F.lit("clean"))
    return p.select("p_partkey", layout.alias("layout"), (F.col("p_size") < 10).alias("low_resolution"), context.alias("context"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity IN (25, 50) AND l_discount * 100 IN (5, 10) AND l_tax >= 0.035 AS usable, CASE WHEN l_quantity NOT IN (25, 50) THEN 'unsupported_calibration' WHEN l_tax < 0.035 THEN 'calibration_conflict' END AS block FROM lineitem""")
def calibration_gates(spark, d):
    li = views.read(spark, d, "lineitem")
    speed, gain = F.col("l_quantity").isin(25.0, 50.0), (F.col("l_discount") * 100).isin(5.0, 10.0)
    return li.select("l_orderkey", "l_linenumber", (speed & gain & (F.col("l_tax") >= 0.035)).alias("usable"), gates.first_reason(("unsupported_calibration", ~speed), ("calibration_conflict", F.col("l_tax") < 0.035)).alias("block"))


@query("""SELECT p_partkey, concat_ws(',', CASE WHEN p_size < 8 THEN 'resolution' END, CASE WHEN p_retailprice > 1600 THEN 'blur' END, CASE WHEN length(p_name) > 20 THEN 'aspect' END) AS reasons, CASE WHEN p_size < 4 THEN 'insufficient' WHEN p_size < 8 OR p_retailprice > 1600 OR length(p_name) > 20 THEN 'review' ELSE 'acceptable' END AS quality,
CASE WHEN p_size < 15 THEN 'warning' ELSE 'pass' END AS edge_check, CASE WHEN p_retailprice < 1000 THEN 'warning' ELSE 'pass' END AS light_check FROM part""")
def input_quality(spark, d):
    p = views.read(spark, d, "part")
    why = gates.reasons(("resolution", F.col("p_size") < 8), ("blur", F.col("p_retailprice") > 1600), ("aspect", F.length("p_name") > 20))
    checks = gates.capture_checks(edge=(F.col("p_size"), 15), light=(F.col("p_retailprice"), 1000))
    return p.select("p_partkey", F.array_join(why, ",").alias("reasons"), F.when(F.col("p_size") < 4, "insufficient").when(F.size(why) > 0, "review").otherwise("acceptable").alias("quality"), checks[0]["status"].alias("edge_check"), checks[1]["status"].alias("light_check"))


@query(f"""WITH {V7}, p AS (SELECT *, CASE WHEN kind = 'N' AND warnings <= 3 THEN 'core' WHEN kind = 'N' OR layout = 'F' THEN 'recovery' ELSE 'exhaustive' END AS phase FROM v7), r AS (SELECT *, row_number() OVER (PARTITION BY run, phase ORDER BY warnings, candidate, crop) AS k FROM p) SELECT run, candidate, phase FROM r WHERE k <= CASE phase WHEN 'core' THEN 5 ELSE 12 END""")
def candidate_plan(spark, d):
    p = views.pools(spark, d)
    phase = F.when((F.col("kind") == "N") & (F.col("warnings") <= 3), "core").when((F.col("kind") == "N") | (F.col("layout") == "F"), "recovery").otherwise("exhaustive")
    ranked = p.withColumn("phase", phase).withColumn("k", F.row_number().over(Window.partitionBy("run", "phase").orderBy("warnings", "candidate", "crop")))
    return ranked.where(F.col("k") <= F.when(F.col("phase") == "core", policy.CORE).otherwise(policy.NEURAL)).select("run", "candidate", "phase")


@query(f"""WITH {V3}, w AS (SELECT *, max(value) OVER (PARTITION BY series, sample) - min(value) OVER (PARTITION BY series, sample) AS spread FROM v3) SELECT series, candidate, round(quantile_cont(spread, 0.5) + 40 * (1 - count(*) / 30.0::DOUBLE) + CASE WHEN candidate = 'click' THEN 12 ELSE 0 END, 5) AS score FROM w GROUP BY 1, 2""")
def consensus_score(spark, d):
    w = Window.partitionBy("series", "sample")
    c = views.candidates(spark, d).withColumn("spread", F.max("value").over(w) - F.min("value").over(w))
    score = F.expr("percentile(spread, 0.5)") + 40 * (1 - F.count("*") / F.lit(30.0)) + F.when(F.col("candidate") == "click", 12).otherwise(0)
    return c.groupBy("series", "candidate").agg(F.round(score, 5).alias("score"))


# time windows and grids


@query(f"""WITH {V2}, c AS (SELECT series, sample, sum(1) OVER (PARTITION BY series ORDER BY sample RANGE BETWEEN CURRENT ROW AND 19 FOLLOWING) AS have FROM v2) SELECT series, sample AS "start", CAST(have AS BIGINT) AS have FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY have DESC, sample) AS k FROM c) WHERE k = 1""")
def densest_window(spark, d):
    v = views.gapped_series(spark, d)
    have = v.withColumn("have", F.count("*").over(Window.partitionBy("series").orderBy("sample").rangeBetween(0, 19)))
    return have.groupBy("series").agg(F.min_by(F.struct("sample", "have"), F.struct(-F.col("have"), F.col("sample"))).alias("b")).select("series", F.col("b.sample").alias("start"), F.col("b.have").alias("have"))


@query("""WITH a AS (SELECT DISTINCT user_id AS k, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) AS t FROM events WHERE event_type = 'purchase'), e AS (SELECT DISTINCT user_id AS k, CAST(floor(epoch_us(ts) / 3.6e9) AS BIGINT) AS t FROM events WHERE event_type = 'view'),
h AS (SELECT unnest(range(-20, 21)) AS shift), n AS (SELECT a.k, h.shift, a.t, (SELECT min(abs(e.t - a.t - h.shift)) FROM e WHERE e.k = a.k) AS gap FROM a, h), s AS (SELECT k, shift, count(*) FILTER (gap <= 1) AS matches, coalesce(sum(gap) FILTER (gap <= 1), 0) AS cost FROM n GROUP BY 1, 2)
SELECT k, CAST(shift AS INT) AS shift, matches FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY matches DESC, cost, abs(shift), shift) AS r FROM s) WHERE r = 1""")
def anchor_shift(spark, d):
    e = views.read(spark, d, "events").select(F.col("user_id").alias("k"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(3.6e9)).cast("long").alias("t"), "event_type")
    a, b = (e.where(F.col("event_type") == x).select("k", "t").distinct() for x in ("purchase", "view"))
    # the hours around a purchase are the bits of one number, bit 0 the earliest; views are bitmaps of as many hours
    reach = policy.ALIGN_RADIUS + 1
    span = 2 * reach + 1
    of = b.groupBy("k", F.floor(F.col("t") / span).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(t, {span}) as int))")).alias("bits"))
    sides = of.select("k", "bits", F.explode(F.array(F.struct("at", F.lit(True).alias("own")), F.struct((F.col("at") - 1).alias("at"), F.lit(False).alias("own")))).alias("s"))
    side = lambda own: F.coalesce(F.max(F.when(F.col("s.own") == own, F.col("bits"))), F.lit(0).cast("long"))
    maps = sides.groupBy("k", F.col("s.at").alias("at")).agg(side(True).alias("low"), side(False).alias("high"))
    met = a.select("k", F.floor((F.col("t") - reach) / span).alias("at"), F.pmod(F.col("t") - reach, F.lit(span)).cast("int").alias("cut")).join(maps, ["k", "at"], "left")
    seen = met.select("k", F.expr(f"coalesce(shiftrightunsigned(low, cut) | (shiftleft(high, {span} - cut) & {2**span - 1}L), 0L)").alias("seen"))
    gap = F.expr(f"transform(sequence(1, {span - 2}), j -> struct(j - {reach} AS shift, CASE WHEN getbit(seen, j) = 1 THEN 0 WHEN getbit(seen, j - 1) = 1 OR getbit(seen, j + 1) = 1 THEN 1 END AS gap))")
    full = seen.select("k", F.explode_outer(F.filter(gap, lambda g: g["gap"].isNotNull())).alias("g")).groupBy("k", F.col("g.shift").alias("shift")).agg(F.count("g.gap").alias("matches"), F.coalesce(F.sum("g.gap"), F.lit(0)).alias("cost"))
    none = F.coalesce("shift", F.lit(0))  # a purchase that no shift brings near a view
    best = F.min_by(F.struct(none.alias("shift"), "matches"), F.struct(-F.col("matches"), F.col("cost"), F.abs(none), none))
    return full.groupBy("k").agg(best.alias("b")).select("k", "b.shift", "b.matches")


@query("""WITH c AS (SELECT c_nationkey AS k, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS x, CAST(floor(c_acctbal) AS BIGINT) % 500 AS y FROM customer)
SELECT k, count(*) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 5) AS at_zero FROM c GROUP BY 1""")
def centroid_line(spark, d):
    x = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    c = views.read(spark, d, "customer").select(F.col("c_nationkey").alias("k"), x.alias("x"), (F.floor("c_acctbal").cast("long") % 500).alias("y"))
    return c.groupBy("k").agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 5).alias("at_zero"))


@query("""SELECT l_suppkey AS k, count(*) AS n, count(*) FILTER (l_quantity >= 10) AS measured, count(*) FILTER (l_quantity >= 10) >= 8 AND count(*) FILTER (l_quantity >= 10) / count(*)::DOUBLE >= 0.8 AS passed, round(quantile_cont(l_quantity, 0.5), 6) AS middle, max(l_quantity) - min(l_quantity) <= 0.9 * quantile_cont(l_quantity, 0.5) AS narrow FROM lineitem GROUP BY 1""")
def grid_consensus(spark, d):
    ok = F.count_if(F.col("l_quantity") >= 10)
    mid = F.expr("percentile(l_quantity, 0.5)")
    return views.read(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), ok.alias("measured"), ((ok >= 8) & (ok / F.count("*") >= 0.8)).alias("passed"), F.round(mid, 6).alias("middle"), (F.max("l_quantity") - F.min("l_quantity") <= F.lit(0.9) * mid).alias("narrow"))


@query("""WITH m AS (SELECT l_orderkey AS k, l_linenumber - 4 AS off, l_quantity - 5 AS lo, l_quantity + 5 AS hi, l_returnflag AS field FROM lineitem) SELECT k, count(*) >= 2 AND count(DISTINCT field) = 1 AND max(lo) < min(hi) AS agreed, CAST(min(CASE WHEN off < 0 THEN -off * 2 - 1 ELSE off * 2 END) AS INT) AS code FROM m GROUP BY 1""")
def window_consensus(spark, d):
    m = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 4).alias("off"), (F.col("l_quantity") - 5).alias("lo"), (F.col("l_quantity") + 5).alias("hi"), F.col("l_returnflag").alias("field"))
    code = F.when(F.col("off") < 0, -F.col("off") * 2 - 1).otherwise(F.col("off") * 2)
    return m.groupBy("k").agg(((F.count("*") >= 2) & (F.count_distinct("field") == 1) & (F.max("lo") < F.min("hi"))).alias("agreed"), F.min(code).cast("int").alias("code"))


@query(f"""WITH {V1}, j AS (SELECT *, abs(value - lag(value) OVER o) > 2.5 OR abs(lead(value) OVER o - value) > 2.5 AS cut FROM v1 WINDOW o AS (PARTITION BY series ORDER BY sample)) SELECT series, sample, NOT coalesce(cut, FALSE) AS valid FROM j""")
def connected_validity(spark, d):
    o = Window.partitionBy("series").orderBy("sample")
    far = (F.abs(F.col("value") - F.lag("value").over(o)) > 2.5) | (F.abs(F.lead("value").over(o) - F.col("value")) > 2.5)
    return views.regular_series(spark, d).select("series", "sample", (~F.coalesce(far, F.lit(False))).alias("valid"))


@query("""WITH r AS (SELECT l_orderkey AS k, l_linenumber AS i, CAST(l_quantity AS INT) * l_linenumber AS lo, CAST(l_quantity AS INT) * l_linenumber + 10 AS hi FROM lineitem), w AS (SELECT *, lag(hi) OVER (PARTITION BY k ORDER BY i, lo) AS p FROM r) SELECT k, min(lo) AS "start", CAST(sum(hi - lo) AS BIGINT) AS width, bool_and(p IS NULL OR p <= lo) AS ordered FROM w GROUP BY 1""")
def contiguous_ranges(spark, d):
    r = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("int") * F.col("l_linenumber")).alias("lo")).withColumn("hi", F.col("lo") + 10)
    p = F.lag("hi").over(Window.partitionBy("k").orderBy("i", "lo"))
    return r.withColumn("ok", p.isNull() | (p <= F.col("lo"))).groupBy("k").agg(F.min("lo").alias("start"), F.sum(F.col("hi") - F.col("lo")).alias("width"), F.every("ok").alias("ordered"))


# lineage weights, references, converted status


@query("""WITH p AS (SELECT l_orderkey AS k, l_partkey % 4 AS idx, l_quantity AS q FROM lineitem), t AS (SELECT k, sum(q) AS s FROM p GROUP BY 1) SELECT p.k, p.idx, round(sum(q / s), 9) AS weight FROM p JOIN t USING (k) GROUP BY 1, 2""")
def native_contributors(spark, d):
    p = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_partkey") % 4).alias("idx"), F.col("l_quantity").alias("q"))
    w = p.withColumn("weight", F.col("q") / F.sum("q").over(Window.partitionBy("k")))
    return w.groupBy("k", "idx").agg(F.round(F.sum("weight"), 9).alias("weight"))


@query(f"""WITH {V2}, m AS (SELECT series, lo + CAST((hi - lo) / 3 AS BIGINT) AS a, lo + CAST((hi - lo) / 3 AS BIGINT) + 2 AS b FROM (SELECT series, min(sample) AS lo, max(sample) AS hi FROM v2 GROUP BY 1)), g AS (SELECT series, sample + 1 AS s, nxt AS e FROM (SELECT series, sample, lead(sample) OVER (PARTITION BY series ORDER BY sample) AS nxt FROM v2) WHERE nxt > sample + 1)
SELECT series, a FROM m WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.series = m.series AND g.s < m.b AND g.e > m.a)""")
def measurement_references(spark, d):
    v = views.gapped_series(spark, d)
    third = F.round((F.max("sample") - F.min("sample")) / 3).cast("long")
    m = v.groupBy("series").agg((F.min("sample") + third).alias("a")).withColumn("b", F.col("a") + 2)
    g = islands.gaps(v, ["series"]).select(F.col("series").alias("gs"), "start", "end")
    return m.join(g, (F.col("series") == F.col("gs")) & (F.col("start") < F.col("b")) & (F.col("end") > F.col("a")), "left_anti").select("series", "a")


@query(f"""WITH {V3}, u AS (SELECT series, sample, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM v3 GROUP BY 1, 2) SELECT l.series, l.sample, greatest(l.spread, r.spread) AS spread, least(l.n, r.n) AS n, CASE WHEN r.sample IS NULL THEN 'uncertainty_unavailable' WHEN greatest(l.spread, r.spread) > 75 THEN 'uncertain_candidate_disagreement' ELSE 'observed' END AS status FROM u l LEFT JOIN u r ON r.series = l.series AND r.sample = l.sample + 1""")
def converted_uncertainty(spark, d):
    u = views.candidates(spark, d).groupBy("series", "sample").agg(F.count("*").alias("n"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))
    r = u.select("series", (F.col("sample") - 1).alias("sample"), F.col("n").alias("n2"), F.col("spread").alias("s2"), F.lit(True).alias("has"))
    spread = F.greatest("spread", "s2")
    return u.join(r, ["series", "sample"], "left").select("series", "sample", spread.alias("spread"), F.least("n", "n2").alias("n"), F.when(F.col("has").isNull(), "uncertainty_unavailable").when(spread > 75, "uncertain_candidate_disagreement").otherwise("observed").alias("status"))


# intake, runs, identities


@query("""SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'not_json' WHEN event_id % 50 = 0 THEN 'bad_id' WHEN value <= 0 THEN 'bad_value' ELSE 'ok' END AS state FROM events""")
def intake_journal(spark, d):
    e = views.read(spark, d, "events")
    return e.select("event_id", F.coalesce(gates.first_reason(("not_json", F.from_json("props", "map<string,string>").isNull()), ("bad_id", F.col("event_id") % 50 == 0), ("bad_value", ~gates.positive(F.col("value")))), F.lit("ok")).alias("state"))


@query("""SELECT o_orderkey AS run, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'failed' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'input' ELSE 'all' END AS assets, o_orderdate < TIMESTAMP '1996-01-01' AND o_orderstatus = 'F' AS purge FROM orders""")
def run_recovery(spark, d):
    o = views.read(spark, d, "orders")
    dead = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 2 == 0)
    return o.select(F.col("o_orderkey").alias("run"), F.when(dead, "failed").otherwise(F.col("o_orderstatus")).alias("status"), F.when(dead, "input").otherwise("all").alias("assets"), ((F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("o_orderstatus") == "F")).alias("purge"))


@query("""SELECT o_orderkey AS run, sha256('lead:' || o_orderstatus || ':' || o_orderkey) AS ident, '{"kind":"' || o_orderstatus || '","layout":null,"threshold":' || (o_orderkey % 7) || '}' AS signature FROM orders""")
def parameter_signatures(spark, d):
    o = views.read(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("run"), text.identity(F.lit("lead"), F.col("o_orderstatus"), F.col("o_orderkey")).alias("ident"), text.signature({"kind": F.col("o_orderstatus"), "layout": F.lit(None).cast("string"), "threshold": F.col("o_orderkey") % 7}).alias("signature"))


@query("""WITH e AS (SELECT DISTINCT user_id, event_type FROM events), a AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) AS parents FROM e GROUP BY 1) SELECT user_id, parents FROM a""")
def candidate_ancestry(spark, d):
    e = views.read(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("ids"))
    joined = F.transform("ids", lambda i: F.concat_ws("+", i, F.element_at("ids", 1)))
    return e.select("user_id", F.array_join(text.ancestry(joined), ",").alias("parents"))


@query("""SELECT l_orderkey AS run, l_linenumber AS segment, unnest(list_filter([CASE WHEN l_quantity < 2 THEN 'short' END, CASE WHEN l_discount > 0.09 THEN 'coverage' END, CASE WHEN l_linenumber > 6 THEN 'panel_index' END], lambda x: x IS NOT NULL)) AS rule FROM lineitem""")
def segment_violations(spark, d):
    li = views.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").alias("segment"), "l_quantity", "l_discount")
    return evidence.violations(li, ["run", "segment"], {"short": F.col("l_quantity") >= 2, "coverage": F.col("l_discount") <= 0.09, "panel_index": F.col("segment") <= 6})


@query(f"""WITH {V2}, g AS (SELECT series, sample + 1 AS s, nxt AS e FROM (SELECT series, sample, lead(sample) OVER (PARTITION BY series ORDER BY sample) AS nxt FROM v2) WHERE nxt > sample + 1), t AS (SELECT series, count(*) AS gaps, sum(e - s) AS missing FROM g GROUP BY 1) SELECT coalesce(gaps >= 20, FALSE) AS many, count(*) AS n, CAST(sum(missing) AS BIGINT) AS missing, GROUPING(gaps >= 20) AS total FROM t GROUP BY ROLLUP (gaps >= 20)""")
def gap_rollup(spark, d):
    t = islands.gaps(views.gapped_series(spark, d), ["series"]).groupBy("series").agg(F.count("*").alias("gaps"), F.sum("length").alias("missing"))
    return t.withColumn("many", F.col("gaps") >= 20).rollup("many").agg(F.count("*").alias("n"), F.sum("missing").alias("missing"), F.grouping("many").cast("long").alias("total")).withColumn("many", F.coalesce("many", F.lit(False)))
