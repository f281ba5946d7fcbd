"""Queries on candidate rules and trust; the oracles restate every rule on the same candidate, lead and pair tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lacuna.functions import candidates as rules
from lacuna.operators import quality, trust
from lacuna.queries import query
from lacuna.sources import trust_views
from lacuna.sources.trust_views import SQL

FACTS = """f AS (SELECT *, coalesce(kind, CASE WHEN vectorizer = 'native-grid-path' THEN 'native-grid' WHEN crop IS NOT NULL THEN 'crop-proposal' WHEN "constraint" IS NOT NULL THEN 'geometry-constrained' WHEN variant = 'preprocessed' THEN 'adaptive-preprocessed' ELSE 'source-model' END) AS kd,
vectorizer = 'native-grid-path' AS native, variant IN ('preprocessed', 'geometry-corrected', 'artifact-preprocessed') AS pre, coalesce(label_thresh < 0.1, FALSE) AS permissive, coalesce(crop, 'full-source') AS ck, timing_confirmed IS NULL OR timing_confirmed AS timed,
(semantic_confirmed AND semantic_order = CASE WHEN starts_with(layout, 'cabrera') THEN 'cabrera' ELSE 'standard' END AND semantic_method <> '') OR (layout = 'standard_6x1_limb' AND order_passed AND selected_order = 'standard') AS explicit FROM cand),
ff AS (SELECT *, kd IN ('panel-composite', 'peer-gap-repair', 'lead-fusion') AS derived, NOT native OR passed AS faithful, NOT explicit AND native AND coalesce("constraint" = layout, FALSE) AND layout <> 'standard_6x1_limb' AND confirmed AND geometry_confidence >= 0.75 AND layout_confidence >= 0.75 AS provisional,
native AND layout = 'standard_3x4' AND NOT panel_timing AND NOT row_timing AS untimed,
CASE WHEN method IS NULL THEN FALSE WHEN method = 'row-local-compound-label-and-algebra-v1' THEN order_passed AND precordial_passed WHEN method = 'row-local-twelve-lead-unverified-v2' THEN order_passed WHEN method = 'row-local-labeled-six-by-two-algebra-validated-v1' THEN order_passed AND precordial_passed
WHEN method = 'row-local-sequential-label-validated-v2' THEN order_passed AND label_passed WHEN method = 'row-local-calibration-anchored-six-by-two-v1' THEN layout_confidence >= 0.8 WHEN method = 'rhythm-anchored-label-validated-three-by-four-v1' THEN label_passed AND anchors >= 3 AND rhythm_passed AND layout_confidence >= 0.35
ELSE with_rhythm AND anchors >= 3 AND rhythm_passed AND layout_confidence >= 0.75 END AS boundary_layout FROM f),
g AS (SELECT *, CASE WHEN NOT eligible THEN 'capability-ineligible' WHEN untimed THEN 'native-panel-timing-unverified' WHEN variant = 'preprocessed' AND NOT adaptive AND NOT confirmed THEN 'preprocessing-unconfirmed' WHEN variant = 'artifact-preprocessed' AND NOT artifact_ok THEN 'artifact-preprocessing-unconfirmed' WHEN native AND pre AND NOT passed THEN 'preprocessed-native-fidelity-failed' END AS why FROM ff)"""
LEADS = """le AS (SELECT l.*, errors = 0 AND finite >= least(expected, greatest(20, ceil(expected * 0.95::DOUBLE))) AS complete, canonical AND passed AND boundary_layout AND finite >= least(expected, greatest(20, ceil(expected * 0.8::DOUBLE))) AND outside = 0 AND errors = 0 AND minimum_coverage >= 0.8 AND excursions = 0 AND lead_excursions = 0 AND unbroken AS boundary,
finite >= ceil(expected * 0.75::DOUBLE) AS covered, native AND coalesce(recovery = 'near-continuous-vertical-source-ink-v1', FALSE) AND lead_jumps > 0 AS risky FROM lds l JOIN g USING (run, id))"""
NAMED = """dp AS (SELECT run, a AS id, b AS peer, lead, rmse FROM prs UNION ALL SELECT run, b, a, lead, rmse FROM prs),
nm AS (SELECT run, id, lead FROM le JOIN g USING (run, id) WHERE in_layout AND (explicit OR provisional OR (g.canonical AND pre AND EXISTS (SELECT 1 FROM g p WHERE p.run = g.run AND p.id <> g.id AND p.provisional AND p.variant = 'geometry-corrected' AND p.ck = g.ck AND p.layout = g.layout)))
UNION SELECT le.run, le.id, le.lead FROM le JOIN g USING (run, id) JOIN dp ON dp.run = le.run AND dp.id = le.id AND dp.lead = le.lead AND rmse <= 75 JOIN g p ON p.run = dp.run AND p.id = dp.peer WHERE in_layout AND g.canonical AND p.canonical AND p.explicit AND p.ck = g.ck AND p.layout = g.layout)"""
TRUST = """rd AS (SELECT le.run, le.id, le.lead, le.complete, le.complete OR le.boundary AS publishable, g.derived, g.native, g.permissive, g.ck, g.layout FROM le JOIN nm USING (run, id, lead) JOIN g USING (run, id) WHERE g.canonical AND g.timed AND g.faithful),
tr AS (SELECT DISTINCT x.run, x.id, x.lead FROM rd x JOIN dp ON dp.run = x.run AND dp.id = x.id AND dp.lead = x.lead AND rmse <= 75 JOIN rd y ON y.run = x.run AND y.id = dp.peer AND y.lead = x.lead WHERE x.publishable AND y.complete AND NOT y.derived AND x.native <> y.native AND x.ck = y.ck AND x.layout = y.layout AND NOT (x.permissive AND y.permissive))"""
ALL = f"WITH {SQL}, {FACTS}"


@query(f"""{ALL} SELECT run, id, kd AS kind, derived, native AS native_grid, pre AS preprocessed, "constraint" IS NOT NULL AS geometry_constrained, native OR (vectorizer = 'dynamic-path' AND dark_ink) AS source_pixels, eligible, variant <> 'original' AS annotation_safe, permissive FROM g""")
def candidate_capabilities(spark, d):
    c, _, _ = trust_views.tables(spark, d)
    return c.select("run", "id", rules.kind().alias("kind"), rules.capabilities().alias("has"), rules.annotation_safe().alias("annotation_safe"), rules.permissive().alias("permissive")).select("run", "id", "kind", "has.*", "annotation_safe", "permissive")


@query(f"""{ALL} SELECT run, id, CASE WHEN timing_confirmed IS NULL THEN 'not_applicable' WHEN timing_confirmed THEN 'verified' ELSE 'unresolved' END AS timing, explicit, provisional, untimed AS untimed_panels, boundary_layout, why AS ineligible,
coalesce("constraint" = layout || CASE WHEN with_rhythm THEN '_with_r1' ELSE '' END, FALSE) AND (NOT native OR method IS NULL OR passed OR (layout_confidence >= 0.3 AND evidence_median >= 0.7 AND evidence_p10 >= 0.2 AND minimum_coverage >= 0.75 AND home_row >= 0.55)) AS review_layout FROM g""")
def candidate_evidence(spark, d):
    c, _, _ = trust_views.tables(spark, d)
    return c.select("run", "id", rules.timing_state().alias("timing"), rules.explicit_identity().alias("explicit"), rules.provisional_identity().alias("provisional"), rules.unverified_panel_timing().alias("untimed_panels"), rules.boundary_layout().alias("boundary_layout"), rules.ineligible().alias("ineligible"), rules.review_layout().alias("review_layout"))


@query(f"""{ALL}, {LEADS} SELECT run, id, lead, in_layout, complete, boundary, complete OR boundary AS publishable, covered AND outside = 0 AS reviewable, risky FROM le""")
def lead_gates(spark, d):
    c, leads, _ = trust_views.tables(spark, d)
    return trust.lead_facts(c, leads).drop("covered")


@query(f"""{ALL}, {LEADS}, {NAMED} SELECT run, id, count(*) AS named, CAST(sum(lead) AS BIGINT) AS leads FROM nm GROUP BY 1, 2""")
def lead_identity(spark, d):
    c, leads, pairs = trust_views.tables(spark, d)
    return trust.identified(trust.facts(c), trust.lead_facts(c, leads), pairs).groupBy("run", "id").agg(F.count("*").alias("named"), F.sum("lead").alias("leads"))


@query(f"""{ALL}, {LEADS}, {NAMED}, {TRUST} SELECT run, id, lead FROM tr""")
def trusted_leads(spark, d):
    return trust.trusted(*trust_views.tables(spark, d))


@query(f"""{ALL}, {LEADS}, {NAMED}, {TRUST}, wh AS (SELECT run, id FROM tr GROUP BY 1, 2 HAVING count(*) = 12)
SELECT run, count(*) FILTER (status = 'completed' AND why IS NULL AND NOT derived AND wh.id IS NOT NULL) AS trusted_candidates, count(*) FILTER (status = 'completed' AND why IS NULL AND NOT derived AND wh.id IS NOT NULL) > 0 AS agreed FROM g LEFT JOIN wh USING (run, id) GROUP BY 1""")
def complete_agreement(spark, d):
    c, leads, pairs = trust_views.tables(spark, d)
    return trust.complete_agreement(c, trust.trusted_bits(c, leads, pairs))


@query(f"""{ALL}, {LEADS}, dp AS (SELECT run, a AS id, b AS peer, lead, rmse FROM prs UNION ALL SELECT run, b, a, lead, rmse FROM prs),
wa AS (SELECT run, id, count(*) AS n, bool_and(covered) AS covered, bool_and(complete) AS complete FROM le WHERE in_layout GROUP BY 1, 2),
mt AS (SELECT run, id, peer, count(*) AS m FROM dp JOIN le USING (run, id, lead) WHERE in_layout AND rmse <= 75 GROUP BY 1, 2, 3),
ok AS (SELECT DISTINCT x.run, x.id FROM g x JOIN wa USING (run, id) JOIN mt ON mt.run = x.run AND mt.id = x.id AND m = wa.n JOIN g y ON y.run = x.run AND y.id = mt.peer JOIN wa wy ON wy.run = y.run AND wy.id = y.id WHERE x.canonical AND NOT x.permissive AND y.canonical AND NOT y.permissive AND NOT y.derived AND wy.covered AND x.ck = y.ck AND x.layout = y.layout)
SELECT g.run, g.id, ok.id IS NOT NULL AS has_peer, ok.id IS NOT NULL AND complete AS complete_peer FROM g JOIN wa USING (run, id) LEFT JOIN ok ON ok.run = g.run AND ok.id = g.id""")
def conservative_peers(spark, d):
    return trust.conservative_peers(*trust_views.tables(spark, d))


@query(f"""{ALL}, {LEADS}, en AS (SELECT run, id FROM le WHERE covered AND outside = 0 GROUP BY 1, 2 HAVING count(*) >= 11)
SELECT DISTINCT x.run, x.id FROM g x JOIN g y ON y.run = x.run AND y.id <> x.id AND y.layout = x.layout JOIN en ON en.run = y.run AND en.id = y.id WHERE x.layout <> 'standard_6x1_limb' AND NOT x.with_rhythm AND y.native AND coalesce(y."constraint" = y.layout, FALSE) AND y.method IS NOT NULL AND y.layout_confidence >= 0.75""")
def native_corroboration(spark, d):
    c, leads, _ = trust_views.tables(spark, d)
    return trust.native_corroboration(c, leads)


@query(f"""{ALL}, {LEADS}, dp AS (SELECT run, a AS id, b AS peer, lead, rmse FROM prs UNION ALL SELECT run, b, a, lead, rmse FROM prs),
wh AS (SELECT run, id FROM le WHERE covered AND outside = 0 GROUP BY 1, 2 HAVING count(*) = 12),
so AS (SELECT g.* FROM g JOIN wh USING (run, id) WHERE native AND canonical AND NOT untimed AND method IS NOT NULL AND layout_confidence >= 0.3 AND minimum_coverage >= 0.75 AND layout <> 'standard_6x1_limb'),
ag AS (SELECT run, id, peer FROM dp GROUP BY 1, 2, 3 HAVING count(*) = 12 AND quantile_cont(rmse, 0.5) <= 60 AND count(*) FILTER (rmse <= 75) >= 9)
SELECT x.run, x.id, count(*) AS peers FROM so x JOIN ag USING (run, id) JOIN so y ON y.run = ag.run AND y.id = ag.peer JOIN orders ON o_orderkey = x.run WHERE x.variant = 'preprocessed' AND x.adaptive AND NOT x.passed AND x.jumps <= x.maximum_jumps + 2 AND y.jumps <= y.maximum_jumps AND x.ck = y.ck AND x.layout = y.layout AND o_totalprice <= 600 * 500 GROUP BY 1, 2""")
def low_resolution_corroboration(spark, d):
    sources = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("run"), (F.col("o_totalprice") / 500).alias("long_edge"))
    return trust.low_resolution_corroboration(*trust_views.tables(spark, d), sources)


FID = "fl AS (SELECT l_orderkey AS run, l_partkey AS p, (40 + l_orderkey % 21)::DOUBLE AS sp, (l_orderkey % 10 + 1) / 10.0::DOUBLE AS lc, l_orderkey % 5 AS an, l_orderkey % 9 > 0 AS rp, 0.65::DOUBLE + l_partkey % 30 / 100.0::DOUBLE AS em, 0.4::DOUBLE + l_suppkey % 50 / 100.0::DOUBLE AS ep, (l_partkey % 47)::DOUBLE AS mj, (l_partkey % 19)::DOUBLE AS pj, 0.78::DOUBLE + l_suppkey % 22 / 100.0::DOUBLE AS cv, 0.5::DOUBLE + l_suppkey % 50 / 100.0::DOUBLE AS hr, l_partkey % 6 AS lj, l_partkey % 4 AS uj, CASE WHEN l_partkey % 40 = 0 THEN 1 ELSE 0 END AS ex FROM lineitem)"


@query(f"""WITH {FID}, a AS (SELECT run, any_value(sp) AS sp, any_value(lc) AS lc, any_value(an) AS an, any_value(rp) AS rp, median(em) AS em, min(ep) AS ep, max(mj) AS mj, max(pj) AS pj, min(cv) AS cv, min(hr) AS hr, CAST(sum(lj) AS BIGINT) AS lj, CAST(sum(uj) AS BIGINT) AS uj, CAST(sum(ex) AS BIGINT) AS ex FROM fl GROUP BY 1),
m AS (SELECT *, run % 3 > 0 AS cr, CAST(greatest(2, ceil(lj * CASE WHEN run % 3 > 0 THEN 0.40::DOUBLE ELSE 0.12::DOUBLE END)) AS BIGINT) AS mx FROM a)
SELECT run, round(em, 6) AS evidence_median, ep AS evidence_p10, mj AS max_jump, pj AS p95_jump, cv AS minimum_coverage, hr AS home_row, lj AS large_jumps, uj AS unsupported_jumps, mx AS maximum_jumps, ex AS excursions,
lc >= 0.45::DOUBLE AND em >= 0.70::DOUBLE AND ep >= 0.45::DOUBLE AND cv >= CASE WHEN cr THEN 0.80::DOUBLE ELSE 0.85::DOUBLE END AND CASE WHEN cr THEN pj <= sp * 0.45::DOUBLE AND mj <= sp * 1.15::DOUBLE AND hr >= 0.55::DOUBLE AND uj <= mx AND ex = 0 AND an >= 3 AND rp ELSE pj <= sp * 0.25::DOUBLE AND mj <= sp * 0.5::DOUBLE END AS passed FROM m""")
def fidelity_reports(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    o, p, s = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    num = lambda e: e.cast("double")
    leads = li.select(
        o.alias("run"), num(o % 21 + 40).alias("row_spacing"), ((o % 10 + 1) / 10.0).alias("layout_confidence"), (o % 5).alias("anchors"), (o % 9 > 0).alias("rhythm_passed"), (F.lit(0.65) + p % 30 / 100.0).alias("evidence_median"), (F.lit(0.4) + s % 50 / 100.0).alias("evidence_p10"), num(p % 47).alias("max_jump"), num(p % 19).alias("p95_jump"),
        (F.lit(0.78) + s % 22 / 100.0).alias("coverage"), (F.lit(0.5) + s % 50 / 100.0).alias("home_row"), (p % 6).alias("large_jumps"), (p % 4).alias("unsupported_jumps"), F.when(p % 40 == 0, 1).otherwise(0).alias("excursions"),
    )
    return quality.fidelity_report(leads, ["run"], F.col("run") % 3 > 0).withColumn("evidence_median", F.round("evidence_median", 6))
