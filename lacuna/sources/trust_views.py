"""Candidates of a run with their leads and pairs, as views of `lineitem`: an order is a run, a line a candidate.

The columns are given as SQL expressions that any engine reads, so a query and its oracle start from the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.functions import candidates as rules
from lacuna.operators.ranges import fixed

_H = "(l_partkey * 7 + l_suppkey * 13 + l_linenumber * 5)"
_pick = lambda step, *names: "CASE " + " ".join(f"WHEN {_H} % {step} = {k} THEN {'NULL' if n is None else repr(n)}" for k, n in enumerate(names[:-1])) + f" ELSE {'NULL' if names[-1] is None else repr(names[-1])} END"
_share = lambda step, low, span: f"CAST({round(low * 100)} + floor(({_H} % {step}) * {round(span * 100)} / {step}) AS DOUBLE) / 1e2"
_flag = lambda step, least: f"({_H} % {step} >= {least})"

COLUMNS = {
    "run": "l_orderkey", "id": "CAST((l_linenumber * 1000000 + l_partkey) * 100000 + l_suppkey AS BIGINT)", "h": _H,
    "status": _pick(17, "failed", "completed"), "layout": "CASE WHEN l_orderkey % 5 = 0 THEN 'standard_6x1_limb' WHEN l_orderkey % 5 = 1 THEN 'cabrera_12x1' WHEN l_orderkey % 5 = 2 THEN 'standard_3x4' ELSE 'standard_6x2' END",
    "with_rhythm": "(l_orderkey % 10 = 2)", "kind": _pick(23, "lead-fusion", "peer-gap-repair", None), "variant": _pick(5, "original", "preprocessed", "geometry-corrected", "annotation-masked", "artifact-preprocessed"),
    "vectorizer": _pick(3, "native-grid-path", "dynamic-path", "probability-centroid"), "label_thresh": "CASE WHEN l_linenumber % 3 = 0 THEN 0.05 WHEN l_linenumber % 3 = 1 THEN 0.2 END",
    "constraint": "CASE WHEN l_linenumber % 2 = 0 THEN CASE WHEN l_orderkey % 5 = 1 THEN 'cabrera_12x1' WHEN l_orderkey % 5 = 2 THEN 'standard_3x4' ELSE 'standard_6x2' END END", "crop": _pick(11, "0:0:9:9", None),
    "canonical": _flag(19, 1), "dark_ink": _flag(2, 1), "eligible": _pick(29, 0, 1).replace("'", "") + " = 1", "adaptive": _flag(4, 1), "confirmed": _flag(6, 2), "artifact_ok": _flag(4, 2), "geometry_confidence": _share(20, 0.6, 0.4),
    "semantic_confirmed": _flag(7, 3), "semantic_order": "CASE WHEN l_orderkey % 5 = 1 THEN 'cabrera' ELSE 'standard' END", "semantic_method": _pick(13, "", "labels-v1"), "semantic_layout": "CAST(NULL AS VARCHAR(40))",
    "timing_confirmed": "CASE WHEN l_linenumber % 4 = 0 THEN " + _flag(9, 2) + " END", "method": _pick(9, None, "row-local-compound-label-and-algebra-v1", "row-local-twelve-lead-unverified-v2", "row-local-labeled-six-by-two-algebra-validated-v1", "row-local-sequential-label-validated-v2", "row-local-calibration-anchored-six-by-two-v1", "rhythm-anchored-label-validated-three-by-four-v1", "other-v1"),
    "passed": _flag(8, 3), "layout_confidence": _share(25, 0.2, 0.8), "evidence_median": _share(10, 0.5, 0.5), "evidence_p10": _share(10, 0.1, 0.8), "minimum_coverage": _share(12, 0.7, 0.3), "home_row": _share(8, 0.4, 0.6),
    "anchors": _H + " % 7", "rhythm_passed": _flag(3, 1), "excursions": f"CASE WHEN {_H} % 15 = 0 THEN 1 ELSE 0 END", "jumps": _H + " % 5", "maximum_jumps": "3", "order_passed": _flag(5, 1), "selected_order": "CASE WHEN l_orderkey % 3 = 0 THEN 'cabrera' ELSE 'standard' END",
    "label_passed": _flag(4, 1), "label_order": "'standard'", "precordial_passed": _flag(6, 1), "panel_timing": _flag(3, 2), "row_timing": _flag(5, 4), "recovery": _pick(6, "near-continuous-vertical-source-ink-v1", None),
}
LEADS = {
    "in_layout": "(layout <> 'standard_6x1_limb' OR lead < 6)", "expected": "CASE WHEN lead = 1 AND with_rhythm THEN 5000 ELSE 416 END", "finite": "CASE WHEN lead = 1 AND with_rhythm THEN 5000 ELSE 416 END - CASE WHEN (h * 3 + lead * 17) % 41 = 0 THEN 70 WHEN (h + lead) % 83 = 0 THEN 130 ELSE (h + lead) % 20 END",
    "outside": "CASE WHEN (h + lead * 5) % 59 = 0 THEN 3 ELSE 0 END", "errors": "CASE WHEN (h + lead * 7) % 67 = 0 THEN 1 ELSE 0 END", "unbroken": "((h + lead) % 11 > 0)", "lead_excursions": "CASE WHEN (h + lead) % 31 = 0 THEN 1 ELSE 0 END", "lead_jumps": "(h + lead) % 4",
}
RMSE = "CAST((x.h + y.h) % 100 + (lead % 3) * 5 AS DOUBLE)"
#: Candidates in a part.
ROWS_IN_PART = 100_000
#: The same tables for a SQL oracle.
SQL = f"""cand AS (SELECT {', '.join(f'{e} AS "{n}"' for n, e in COLUMNS.items())} FROM lineitem),
lds AS (SELECT run, id, lead, {', '.join(f'{e} AS {n}' for n, e in LEADS.items())} FROM cand, (SELECT unnest(range(12)) AS lead)),
prs AS (SELECT x.run, x.id AS a, y.id AS b, lead, {RMSE} AS rmse FROM cand x JOIN cand y ON x.run = y.run AND x.id < y.id, (SELECT unnest(range(12)) AS lead) WHERE x.canonical AND y.canonical)"""


def tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """candidates, leads, pairs (one row a pair, with its leads and the bits of those that agree)."""
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    # dealt by run while a candidate is four numbers: its leads, twelve rows each, and its pairs then lie beside it. All that is
    # made of them needs the same four, so they are dealt once. The number of parts follows the rows, not the bytes shuffled,
    # since each part grows by its leads and pairs afterwards.
    dealt = raw.repartition(max(spark.sparkContext.defaultParallelism, -(-raw.count() // ROWS_IN_PART)), "l_orderkey")
    candidates = dealt.selectExpr(*(f"{e} AS `{n}`" for n, e in COLUMNS.items()))
    each = candidates.selectExpr("*", "explode(sequence(0L, 11L)) AS lead")
    leads = each.selectExpr("run", "id", "lead", *(f"{e} AS {n}" for n, e in LEADS.items()))
    side = fixed(candidates.select("run", "id", "h", "canonical"), canonical=F.col("canonical")).where("canonical")
    x, y = side.selectExpr("run", "id AS a", "h AS xh"), side.selectExpr("run", "id AS b", "h AS yh")
    rmse = [F.expr(RMSE.replace("x.h", "xh").replace("y.h", "yh").replace("lead", str(k))) for k in range(12)]
    leads_of_pair = F.array(*(F.struct(F.lit(k).cast("long").alias("lead"), v.alias("rmse")) for k, v in enumerate(rmse)))
    pairs = x.join(y.hint("shuffle_hash"), "run").where("a < b").select("run", "a", "b", leads_of_pair.alias("leads"), rules.agreeing(rmse).alias("near"))
    return candidates, leads, pairs
