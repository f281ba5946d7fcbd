"""Queries on stored records: runs, journals, layouts, reviews, run lists and written tables, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import contracts
from lacuna.operators import evidence
from lacuna.queries import query
from lacuna.sources import signals, views

K = "o_orderkey"
_odd = lambda step, bad, good: f"CASE WHEN {K} % {step} = 0 THEN {bad} ELSE {good} END"
_text = lambda e: f"CAST({e} AS VARCHAR(40))"
_SHA = f"CASE WHEN {K} % 43 = 0 THEN 'XYZ' ELSE repeat('0a1b2c3d4e5f6789', 4) END"
#: Text of a journal; both engines read this expression, the rules are stated apart.
JOURNAL = " || ".join([
    f"'{{\"version\":' || {_odd(41, repr('2'), repr('1'))}", f"',\"runId\":\"' || {_odd(37, repr('../x'), _text(K))}", f"'\",\"fileName\":\"' || {_odd(31, repr('a b.png'), repr('a_b.png'))}", "'\",\"safeFileName\":\"a_b.png\",\"fileSizeBytes\":'", _odd(29, "'99999999999'", _text(f"{K} * 1000")),
    f"',\"sourceSha256\":\"' || {_SHA}", f"'\",\"createdAt\":\"' || {_odd(23, repr('never'), repr('2024-01-02 03:04:05'))}", f"'\",\"storage\":{{\"version\":1,\"admittedAt\":\"2024-01-02 03:04:05\",\"minimumFreeBytes\":' || {_odd(19, repr('5'), repr('5368709120'))}", f"',\"reservedBytes\":' || {_odd(17, repr('16'), repr('1073741824'))}",
    f"'}},\"owner\":{{\"ownerId\":\"' || {_odd(13, repr(''), repr('me'))}", f"'\",\"pid\":' || {_odd(47, repr('0'), repr('7'))} || ',\"hostname\":\"h\"}}'", f"CASE WHEN {K} % 11 = 0 THEN ',\"captureQuality\":{{\"outcome\":\"' || {_odd(2, repr('retake'), repr('ready'))} || '\",\"sourceSha256\":\"' || {_SHA} || '\"}}' ELSE '' END", _odd(53, "''", "'}'"),
])


@query(f"""WITH t AS (SELECT {K} AS run, CAST({JOURNAL} AS VARCHAR) AS j FROM orders), v AS (SELECT run, CASE WHEN json_valid(j) THEN CAST(j AS JSON) END AS j FROM t),
p AS (SELECT run, j IS NOT NULL AS ok, CAST(j ->> '$.version' AS INT) AS version, j ->> '$.runId' AS run_id, j ->> '$.fileName' AS file_name, j ->> '$.safeFileName' AS safe, CAST(j ->> '$.fileSizeBytes' AS BIGINT) AS size, j ->> '$.sourceSha256' AS sha, j ->> '$.createdAt' AS made, CAST(j ->> '$.storage.minimumFreeBytes' AS BIGINT) AS free, CAST(j ->> '$.storage.reservedBytes' AS BIGINT) AS res, j ->> '$.owner.ownerId' AS owner, CAST(j ->> '$.owner.pid' AS INT) AS pid, j ->> '$.captureQuality.outcome' AS q, j ->> '$.captureQuality.sourceSha256' AS qsha FROM v)
SELECT run, unnest(CASE WHEN NOT ok THEN ['version', 'run_id', 'file_name', 'safe_file_name', 'file_size', 'source_sha256', 'created_at', 'storage_version', 'admitted_at', 'minimum_free', 'reserved', 'owner_id', 'pid', 'hostname'] ELSE list_filter([CASE WHEN version <> 1 THEN 'version' END, CASE WHEN NOT regexp_matches(run_id, '^[A-Za-z0-9][A-Za-z0-9._-]*$') THEN 'run_id' END, CASE WHEN safe <> replace(file_name, ' ', '_') THEN 'safe_file_name' END, CASE WHEN size > 52428800 THEN 'file_size' END, CASE WHEN sha = 'XYZ' THEN 'source_sha256' END, CASE WHEN made = 'never' THEN 'created_at' END, CASE WHEN free < 5368709120 THEN 'minimum_free' END,
CASE WHEN res < greatest(1073741824, size * 16) THEN 'reserved' END, CASE WHEN owner = '' THEN 'owner_id' END, CASE WHEN pid <= 0 THEN 'pid' END, CASE WHEN q IS NOT NULL AND NOT (q = 'ready' AND qsha = sha) THEN 'capture_quality' END], lambda x: x IS NOT NULL) END) AS rule FROM p""")
def journal_violations(spark, d):
    parsed = views.read(spark, d, "orders").selectExpr(f"{K} AS run", f"{JOURNAL} AS source").withColumn("j", contracts.journal(F.col("source")))
    return evidence.violations(parsed, ["run"], contracts.journal_rules(F.col("j")))


@query(f"""WITH r AS (SELECT {K} AS k, o_totalprice AS price, o_orderstatus AS st FROM orders),
x AS (SELECT k, k % 7 = 0 AS lean, k % 5 = 0 AS rel, k % 6 = 0 AS ph, CASE WHEN k % 12 = 0 THEN 'diagnostic_available' WHEN k % 18 = 0 THEN 'failed' ELSE 'pending' END AS state, CASE WHEN k % 4 = 0 THEN 'diagnostic_source_photo' ELSE 'agreed' END AS reason, CASE WHEN k % 8 = 0 THEN 'partial' ELSE 'needs_review' END AS outcome, k % 3 = 0 AS diag, price, st FROM r)
SELECT k AS run, unnest(list_filter([CASE WHEN st = 'P' THEN 'invalid_run_header' END, CASE WHEN k % 10 = 0 THEN 'invalid_sample_rate' END, CASE WHEN k % 9 = 0 THEN 'invalid_gain' END, CASE WHEN price / 400000.0::DOUBLE > 1 THEN 'invalid_calibration_confidence' END, CASE WHEN k % 16 = 0 THEN 'invalid_file_size' END, CASE WHEN lean AND k % 2 = 0 THEN 'invalid_retention_contract' END, CASE WHEN rel AND k % 2 = 0 THEN 'invalid_reliability_width' END, CASE WHEN rel AND k % 3 = 0 THEN 'invalid_reliability_missing' END, CASE WHEN rel AND k % 4 = 0 THEN 'invalid_reliability_evidence' END,
CASE WHEN ph AND state <> 'failed' AND k % 24 <> 0 AND k % 30 = 0 THEN 'source_photo_manifest_identity_mismatch' END, CASE WHEN (ph AND state = 'diagnostic_available' AND NOT (reason = 'diagnostic_source_photo' AND outcome = 'partial' AND diag)) OR (reason = 'diagnostic_source_photo' AND NOT (ph AND state = 'diagnostic_available')) THEN 'invalid_source_photo_publication' END], lambda x: x IS NOT NULL)) AS rule FROM x""")
def run_violations(spark, d):
    k = F.col(K)
    when = lambda step, bad, good: F.when(k % step == 0, bad).otherwise(good)
    lean = F.when(k % 7 == 0, F.struct(F.when(k % 2 == 0, 1).otherwise(2).alias("version"), F.lit("lean-final-evidence-v2").alias("policy"), F.array(F.lit("x")).alias("removed")))
    trust = F.when(k % 5 == 0, F.struct(when(2, 0.0, 10.0).alias("width"), F.lit(5.0).alias("height"), F.lit(500.0).alias("nominal_rate"), F.lit(200.0).alias("effective_rate"), F.lit(0).alias("masked_pixels"), F.lit(0).alias("uncertain"), when(3, -1, 4).alias("missing"), F.lit(0.5).alias("masked_fraction"), (k % 4 == 0).alias("reconstructed"), F.lit(True).alias("preserved")))
    state = F.when(k % 12 == 0, "diagnostic_available").when(k % 18 == 0, "failed").otherwise("pending")
    photo = F.when(k % 6 == 0, F.struct(state.alias("state"), F.lit("aa").alias("manifest_sha256")))
    assets = F.when(k % 3 == 0, F.array(*(F.lit(x) for x in contracts.DIAGNOSTIC))).otherwise(F.array(F.lit("canonicalCsv")))
    runs = views.read(spark, d, "orders").select(
        k.cast("string").alias("id"), k.alias("run"), F.lit("p").alias("local_path"), F.lit("upload").alias("source"), F.when(F.col("o_orderstatus") == "P", "lost").otherwise("completed").alias("status"), assets.alias("assets"), when(10, 0.0, 500.0).alias("sample_rate"), F.lit(None).cast("double").alias("effective_rate"), F.lit(25.0).alias("paper_speed"), when(9, -1.0, 10.0).alias("gain"),
        (F.col("o_totalprice") / 400000.0).alias("calibration_confidence"), F.lit(12).alias("lead_count"), when(16, -1, 1).alias("file_size"), lean.alias("retention"), trust.alias("reliability"), photo.alias("photo"), F.when((k % 24 == 0) | (k % 30 != 0), "aa").otherwise("bb").alias("manifest_sha256"), when(4, "diagnostic_source_photo", "agreed").alias("reason_code"), when(8, "partial", "needs_review").alias("outcome"),
    )
    return evidence.violations(runs, ["run"], contracts.run_rules())


@query("""WITH l AS (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN 2 ELSE 1 END AS version, p_size - 2 AS page_rows, ['I', 'V6', CASE WHEN p_partkey % 9 = 0 THEN 'V7' ELSE 'aVF' END] AS leads FROM part)
SELECT p_partkey, unnest(list_filter([CASE WHEN version <> 1 THEN 'version' END, CASE WHEN page_rows <= 0 THEN 'page_rows' END, CASE WHEN list_contains(leads, 'V7') THEN 'unknown_lead' END], lambda x: x IS NOT NULL)) AS rule FROM l""")
def layout_violations(spark, d):
    p = views.read(spark, d, "part")
    table = p.select("p_partkey", F.when(F.col("p_partkey") % 50 == 0, 2).otherwise(1).alias("version"), (F.col("p_size") - 2).alias("page_rows"), F.array(F.lit("I"), F.lit("V6"), F.when(F.col("p_partkey") % 9 == 0, "V7").otherwise("aVF")).alias("leads"))
    return evidence.violations(table, ["p_partkey"], contracts.layout_rules())


@query(f"""SELECT {K} AS run, {K} % 2 = 0 AND {K} % 3 > 0 AND {K} % 5 > 0 AS confirmed, o_orderstatus = 'O' AND {K} % 4 > 0 AND ({K} % 7 > 0 OR {K} % 3 > 0) AS acceptable FROM orders""")
def review_gates(spark, d):
    k = F.col(K)
    said = F.create_map(F.lit("sourceCompared"), k % 2 == 0, F.lit("leadIdentityVerified"), F.when(k % 3 > 0, True), F.lit("scaleAndGapsReviewed"), k % 5 > 0)
    assets = F.filter(F.array(F.lit("canonicalCsv"), F.when(k % 4 > 0, "segmentsCsv"), F.lit("uncertaintyCsv"), F.lit("segmentMapJson"), F.when(k % 3 > 0, "provenanceJson")), lambda x: x.isNotNull())
    o = views.read(spark, d, "orders")
    return o.select(k.alias("run"), contracts.confirmed(said).alias("confirmed"), contracts.acceptable(F.when(F.col("o_orderstatus") == "O", "needs_review").otherwise("failed"), assets, F.when(k % 7 == 0, 2)).alias("acceptable"))


@query(f"""SELECT o_custkey AS owner, {K} AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, {K}) AS place FROM orders""")
def listed_runs(spark, d):
    o = views.read(spark, d, "orders")
    return evidence.listed(o.select(F.col("o_custkey").alias("owner"), F.col(K).alias("run"), "o_orderdate"), ["owner"], "o_orderdate", "run").select("owner", "run", "place")


@query("""WITH u AS (SELECT user_id AS series, CAST(floor(epoch_us(ts) / 1e6 / 86400) AS BIGINT) AS sample, count(*) AS n, round(max(value) - min(value), 6) AS spread FROM events GROUP BY 1, 2)
SELECT 's' || series AS lead, CAST(sample AS INT) AS lead_sample, sample / 500.0::DOUBLE AS t_s_at_500hz, CASE WHEN spread > 75 THEN 'uncertain_candidate_disagreement' ELSE 'observed' END AS status, CAST(n AS INT) AS candidate_count, spread AS candidate_spread_uv FROM u""")
def written_uncertainty(spark, d):
    """The uncertainty table written as CSV and read back."""
    from pyspark.sql import functions as f

    e = views.read(spark, d, "events").select("user_id", f.floor(f.unix_micros(f.col("ts").cast("timestamp")) / f.lit(86400e6)).cast("long").alias("sample"), "value")
    u = e.groupBy("user_id", "sample").agg(f.count("*").cast("int").alias("candidate_count"), f.round(f.max("value") - f.min("value"), 6).alias("candidate_spread_uv"))
    rows = u.select(f.concat(f.lit("s"), f.col("user_id")).alias("lead"), f.col("sample").cast("int").alias("lead_sample"), (f.col("sample") / 500.0).alias("t_s_at_500hz"), f.col("sample").cast("int").alias("canonical_sample"), f.lit(None).cast("double").alias("value_uv"), f.lit(None).cast("double").alias("review_estimate_uv"), f.when(f.col("candidate_spread_uv") > 75, "uncertain_candidate_disagreement").otherwise("observed").alias("status"), f.lit(0).alias("annotation_overlap"), "candidate_count", "candidate_spread_uv")
    return signals.read_uncertainty(spark, signals.write_uncertainty(rows)).select("lead", "lead_sample", "t_s_at_500hz", "status", "candidate_count", "candidate_spread_uv")


@query(f"""SELECT {K} AS run, CASE WHEN {K} % 17 = 0 OR {K} % 19 = 0 OR ({K} % 5 > 0 AND {K} % 23 = 0) THEN 'missing_original_identity' WHEN {K} % 3 > 0 AND {K} % 2 = 0 AND {K} % 7 > 0 THEN 'available_for_source_review' ELSE 'unavailable' END AS state FROM orders""")
def interpreter_states(spark, d):
    k = F.col(K)
    assets = F.filter(F.array(F.when(k % 19 != 0, "input"), F.lit("segmentsCsv"), F.when(k % 7 != 0, "uncertaintyCsv"), F.lit("provenanceJson")), lambda x: x.isNotNull())
    state = contracts.interpreter_state(F.when(k % 5 != 0, F.when(k % 23 == 0, "other").otherwise("own")), F.when(k % 17 != 0, "own"), F.when(k % 3 != 0, "sha"), assets, k % 2 == 0)
    return views.read(spark, d, "orders").select(k.alias("run"), state.alias("state"))


@query("""WITH r AS (SELECT p_partkey AS k, p_size AS z FROM part)
SELECT k AS p_partkey, unnest(list_filter([CASE WHEN k % 31 = 0 OR k % 29 = 0 THEN 'invalid_preprocessing_provenance' END,
CASE WHEN k % 31 > 0 AND k % 3 = 0 AND (k % 7 = 0 OR k % 4 = 0 OR k % 10 = 0 OR z = 1) THEN 'invalid_input_quality' END,
CASE WHEN k % 2 = 0 AND (k % 9 = 0 OR k % 14 = 0) THEN 'invalid_transform' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def preparation_violations(spark, d):
    k = F.col("p_partkey")
    bad = lambda step, wrong, right: F.when(k % step == 0, wrong).otherwise(right)
    matrix = F.array(*(x.cast("double") for x in (F.lit(1), F.lit(0), F.lit(2), bad(9, 1, 0), bad(9, 0, 1), bad(9, 2, 3), F.lit(0), F.lit(0), F.lit(1))))
    reports = views.read(spark, d, "part").select(
        "p_partkey", F.when(k % 31 == 0, 4).when(k % 3 == 0, 7).otherwise(6).alias("version"), bad(29, "no", "0a1b2c3d4e5f6789" * 4).alias("sha"), F.struct(F.lit(1000).alias("width"), F.lit(600).alias("height")).alias("source"),
        F.struct(F.lit(500).alias("width"), F.lit(300).alias("height"), bad(7, 0.6, 0.5).alias("scale_x"), F.lit(0.5).alias("scale_y"), F.lit("m").alias("method"), F.when(F.col("p_size") == 1, 499).otherwise(4000).alias("most")).alias("working"),
        F.struct(bad(4, "insufficient", "review").alias("outcome"), F.lit(True).alias("eligible"), bad(10, 999, 1000).alias("long_edge"), F.lit(600).alias("short_edge"), F.lit(0.5).alias("scale"), F.array(F.lit("r")).alias("reasons")).alias("quality"),
        F.when(k % 2 == 0, F.struct(F.lit(True).alias("applied"), F.lit("m").alias("method"), F.lit(0.9).alias("confidence"), F.lit(10).alias("width"), F.lit(10).alias("height"), matrix.alias("transform"), (k % 14 == 0).alias("reconstructed"))).alias("correction"),
    )
    return evidence.violations(reports, ["p_partkey"], contracts.preparation_rules())
