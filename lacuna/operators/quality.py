"""Quality of series and candidates: coverage, amplitude, warnings, disagreement, reliability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions import gates
from lacuna.plans import policy

from .islands import gaps


def nearest_rank(value: str, share: float) -> Column:
    """Nearest-rank percentile; 0 for no values."""
    return F.coalesce(F.expr(f"percentile_disc({share}) within group (order by {value})"), F.lit(0.0))


def series_quality(df: DataFrame, by: list[str]) -> DataFrame:
    """by, expected, finite, missing, max_gap, amplitude (nearest-rank P99 - P01)."""
    found = df.where("value is not null")
    base = found.groupBy(*by).agg((F.max("sample") - F.min("sample") + 1).alias("expected"), F.count("*").alias("finite"), (nearest_rank("value", 0.99) - nearest_rank("value", 0.01)).alias("amplitude"))
    longest = gaps(found, by).groupBy(*by).agg(F.max("length").alias("max_gap"))
    return base.join(longest, by, "left").select(*by, "expected", "finite", (F.col("expected") - F.col("finite")).alias("missing"), F.coalesce("max_gap", F.lit(0)).cast("long").alias("max_gap"), F.round("amplitude", 6).alias("amplitude"))


def gap_warnings(df: DataFrame, by: list[str], least: int = policy.GAP_WARNING, most: int = policy.GAP_WARNINGS_PER_SERIES) -> DataFrame:
    """by, start, length, kind of a series' longest gaps: `transition` near its ends, else `interior`."""
    found = df.where("value is not null")
    span = found.groupBy(*by).agg(F.min("sample").alias("lo"), (F.max("sample") - F.min("sample") + 1).alias("n"))
    ranked = gaps(found, by).where(F.col("length") >= least).withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("length"), "start"))).where(F.col("k") <= most)
    at = (F.col("start") - F.col("lo")) / F.col("n")
    until = (F.col("start") + F.col("length") - F.col("lo")) / F.col("n")
    return ranked.join(span, by).select(*by, "start", "length", F.when((at < policy.TRANSITION) | (until > 1 - policy.TRANSITION), "transition").otherwise("interior").alias("kind"))


def candidate_gates(q: DataFrame, by: list[str]) -> DataFrame:
    """Per key: counts of scorable, complete and reviewable series, least coverage, and whether all are scorable."""
    e, f = F.col("expected"), F.col("finite")
    flat = (f >= policy.MIN_SAMPLES) & (F.col("amplitude") < policy.NEAR_FLAT)
    ok = gates.scorable(e, f, flat)
    return q.groupBy(*by).agg(
        F.count_if(ok).alias("scorable"), F.count_if(f >= gates.least_complete(e)).alias("complete"), F.count_if(gates.reviewable(e, f, F.lit(0))).alias("reviewable"), F.round(F.coalesce(F.min(f / e), F.lit(0.0)), 6).alias("least_coverage"), F.every(ok).alias("all_scorable"), F.sum("missing").alias("missing"), F.count_if(flat).alias("errors"),
    )


def uncertainty(df: DataFrame, by: list[str], annotated: Column, limit: float = policy.DISAGREEMENT) -> DataFrame:
    """by, candidate_count, spread (0 for one candidate) and status of each sample of competing candidates."""
    grouped = df.groupBy(*by).agg(F.count("value").alias("candidate_count"), F.round(F.max("value") - F.min("value"), 6).alias("spread"))
    return grouped.withColumn("status", gates.status_of_sample(annotated, F.col("candidate_count") == 0, F.col("spread"), limit))


def uncertainty_summary(u: DataFrame, by: list[str]) -> DataFrame:
    return u.groupBy(*by).agg(F.count_if(F.col("status").startswith("uncertain")).alias("uncertain"), F.count_if(F.col("status") == "missing").alias("missing"), F.count_if(F.col("status").contains("disagreement")).alias("disagreements"), nearest_rank("spread", 0.95).alias("spread_p95"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("spread_max"))


def reliability(u: DataFrame, by: list[str]) -> DataFrame:
    """confidence and its reasons."""
    s = uncertainty_summary(u, by)
    why = gates.reasons(("missing_samples", F.col("missing") > 0), ("candidate_disagreement", F.col("disagreements") > 0), ("annotation_overlap", F.col("uncertain") > F.col("disagreements")))
    return s.select(*by, "uncertain", "missing", F.when(F.size(why) > 0, "lower").otherwise("standard").alias("confidence"), F.array_join(why, ",").alias("reasons"))


def pair_rmse(df: DataFrame, by: list[str], ident: str, on: list[str]) -> DataFrame:
    """by, a, b (a < b), n, rmse after removing the median difference: once for each unordered pair of a key.

    The join is on the key and the sample, so a pair's rows meet where the samples are; pairs without a common sample
    don't appear.
    """
    keys = [*by, *on]
    left = df.select(*keys, F.col(ident).alias("a"), F.col("value").alias("va"))
    right = df.select(*keys, F.col(ident).alias("b"), F.col("value").alias("vb"))
    both = left.join(right, keys).where("a < b and va is not null and vb is not null").withColumn("d", F.col("vb") - F.col("va"))
    # around the median in one aggregate: the variance and the mean's distance from the median
    off = F.avg("d") - F.expr("percentile(d, 0.5)")
    return both.groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.sqrt(F.var_pop("d") + off * off).alias("rmse"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions, from one reading of the pairs."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ends = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    return pairs.select(*rest, ends.alias("_ends")).select("_ends.a", "_ends.b", *rest)


def disagreement(pairs: DataFrame, by: list[str], weight: float = policy.DISAGREEMENT_WEIGHT) -> DataFrame:
    """by, candidate, penalty: rounded weight times the median error against its peers."""
    return both_ways(pairs).groupBy(*by, F.col("a").alias("candidate")).agg(gates.js_round(F.expr("percentile(rmse, 0.5)") * weight).cast("long").alias("penalty"), F.count("*").alias("peers"))


def trusted(df: DataFrame, pairs: DataFrame, by: list[str], ident: str, independent: Column, limit: float = policy.DISAGREEMENT) -> DataFrame:
    """Rows of df with an independent peer within the limit (left semi join on the pair table); independent: over a, b."""
    good = both_ways(pairs).where((F.col("rmse") <= limit) & independent).select(*by, F.col("a").alias(ident))
    return df.join(good, [*by, ident], "left_semi")


def fidelity(path: DataFrame, by: list[str]) -> DataFrame:
    """Per traced path: evidence median and P10 (linear), largest and P95 jump, coverage, jumps beyond 3."""
    jump = F.abs(F.col("y") - F.lag("y").over(Window.partitionBy(*by).orderBy("x")))
    q = lambda c, p: F.round(F.expr(f"percentile({c}, {p})"), 6)
    return path.withColumn("jump", jump).groupBy(*by).agg(q("evidence", 0.5).alias("evidence_median"), q("evidence", 0.1).alias("evidence_p10"), F.round(F.max("jump"), 6).alias("max_jump"), q("jump", 0.95).alias("jump_p95"), F.round(F.avg(F.col("valid").cast("int")), 6).alias("coverage"), F.count_if(F.col("jump") > 3).alias("large_jumps"))


def histogram_percentile(bins: DataFrame, by: list[str], share: float) -> DataFrame:
    """First bin at which the running count reaches the share; bins has by, bin, count."""
    w = Window.partitionBy(*by)
    run = bins.withColumn("run", F.sum("count").over(w.orderBy("bin"))).withColumn("total", F.sum("count").over(w))
    return run.where(F.col("run") >= F.col("total") * F.lit(share)).groupBy(*by).agg(F.min("bin").alias("bin"))


def unit_scale(df: DataFrame, by: list[str]) -> DataFrame:
    """value clipped to its linear 5 % and 99.5 % quantiles and scaled to 0..1; a flat series is 0."""
    q = df.groupBy(*by).agg(F.expr("percentile(value, 0.05)").alias("lo"), F.expr("percentile(value, 0.995)").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), gates.clamp((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")), 0.0, 1.0)).otherwise(0.0)
    return df.join(q, by).withColumn("value", scaled).drop("lo", "hi")


def fidelity_report(leads: DataFrame, by: list[str], crossings: Column) -> DataFrame:
    """by, the leads' fidelity put together, and passed; leads: a row for each lead of a trace.

    leads has by.., row_spacing, layout_confidence, anchors, rhythm_passed (of the trace) and evidence_median, evidence_p10,
    max_jump, p95_jump, coverage, home_row, large_jumps, unsupported_jumps, excursions. `crossings` (over by) says that jumps
    which ink backs are allowed: then more of them pass, but each must be supported and the rhythm anchored.
    """
    limit = policy.FIDELITY
    c = F.col
    whole = leads.groupBy(*by).agg(
        *(F.first(k).alias(k) for k in ("row_spacing", "layout_confidence", "anchors", "rhythm_passed")), F.percentile("evidence_median", F.lit(0.5)).alias("evidence_median"), F.min("evidence_p10").alias("evidence_p10"), F.max("max_jump").alias("max_jump"), F.max("p95_jump").alias("p95_jump"),
        F.min("coverage").alias("minimum_coverage"), F.min("home_row").alias("home_row"), F.sum("large_jumps").alias("large_jumps"), F.sum("unsupported_jumps").alias("unsupported_jumps"), F.sum("excursions").alias("excursions"),
    ).withColumn("_cross", crossings)
    allowed = F.greatest(F.lit(2), F.ceil(c("large_jumps") * F.when(c("_cross"), limit["unsupported"]).otherwise(limit["unsupported_plain"]))).cast("long")
    shared = (c("layout_confidence") >= limit["layout"]) & (c("evidence_median") >= limit["median"]) & (c("evidence_p10") >= limit["p10"]) & (c("minimum_coverage") >= F.when(c("_cross"), limit["coverage"]).otherwise(limit["coverage_plain"]))
    within = lambda p95, most: (c("p95_jump") <= c("row_spacing") * p95) & (c("max_jump") <= c("row_spacing") * most)
    crossing = within(limit["crossing_p95"], limit["crossing_jump"]) & (c("home_row") >= limit["home_row"]) & (c("unsupported_jumps") <= c("maximum_jumps")) & (c("excursions") == 0) & (c("anchors") >= 3) & c("rhythm_passed")
    jumps = F.when(c("_cross"), crossing).otherwise(within(0.25, 0.50))
    return whole.withColumn("maximum_jumps", allowed).withColumn("passed", F.coalesce(shared & jumps, F.lit(False))).select(*by, "evidence_median", "evidence_p10", "max_jump", "p95_jump", "minimum_coverage", "home_row", "large_jumps", "unsupported_jumps", "maximum_jumps", "excursions", "passed")
