"""Queries on JSON reports and on proof hashes.

A part has a layout report and an order a native report, each by a scenario of its key: the report as it should be, or one
with a single field changed, removed or of another type. The oracles say what each scenario breaks, without reading JSON.
"""

from __future__ import annotations

import copy
import json

from pyspark.sql import functions as F

from lacuna.functions import proofs, reports
from lacuna.plans import policy
from lacuna.queries import query
from lacuna.sources import views

_GONE = object()


def _changed(base: dict, *changes: tuple[str, object]) -> str:
    """JSON of a report with the fields at dotted paths set or removed."""
    out = copy.deepcopy(base)
    for path, value in changes:
        *way, last = path.split(".")
        at = out
        for step in way:
            at = at[int(step)] if isinstance(at, list) else at[step]
        if value is _GONE:
            del at[last]
        elif isinstance(at, list):
            at[int(last)] = value
        else:
            at[last] = value
    return json.dumps(out, separators=(",", ":"))


_BOX = {"left": 5, "top": 5, "right": 900, "bottom": 500}
_SEMANTIC = {"passed": True, "semanticIdentityConfirmed": True, "method": "m", "confidence": 0.9, "failureReasons": [], "order": "standard", "expectedLabels": ["I", "II"], "recognizedLabels": ["I", "II"]}
_NAMES = [n for line in policy.LABEL_ROWS for n in line]
_GRID = {
    "version": 1, "method": "source-value-grid-below-trace-v1", "maskMethod": "maximum-channel-below-160-v1", "imageSize": [1000, 700], "rowSpacing": 150, "columnSpacing": 200.5, "fontHeight": 14, "xFit": [1, 2, 3], "yFit": [1, 2, 3.5], "labelRowCenters": [100, 250, 400, 550], "maximumXResidual": 0, "maximumYResidual": 1.5,
    "slots": [{"lead": n, "row": i // 4, "column": i % 4, "box": [200 * (i % 4), 90 + 150 * (i // 4), 200 * (i % 4) + 50, 110 + 150 * (i // 4)]} for i, n in enumerate(_NAMES)], "rhythmSlot": {"lead": "II", "row": 3, "column": 0, "box": [0, 540, 50, 560]},
    "anchors": [{"lead": n, "confidence": 0.8, "x": 10, "y": 20.5, "width": 30, "height": 9} for i, n in enumerate(_NAMES) if i % 4][:7],
}
_CALIBRATION = {"detected": True, "method": "m", "confidence": 0.8, "gridScaleMm": 1, "pixelsPerMmX": 4.02, "pixelsPerMmY": 4, "paperSpeedMmPerSecond": 25, "gainMmPerMv": 10, "gridScaleMmY": None, "rowPixelsPerMmX": [4.0, 4.01, 4.02, 4.02, 4.03, 4.04], "horizontalScaleEvidence": {"version": 1, "method": "consistent-row-grid-median-v1", "priorPixelsPerMmX": 4.1, "rowCount": 6, "relativeRange": (4.04 - 4.0) / 4.02}}
_LAYOUT = {"version": 1, "image": {"width": 1000, "height": 700}, "layoutHint": "standard_3x4_with_r1", "rowCenters": [100, 250.5, 400], "confidence": 0.75, "sourceLabelGrid": _GRID, "leadLabelValidation": {"semanticIdentityConfirmed": True, "semanticRecognition": _SEMANTIC}, "limbLabelValidation": {}, "contentBox": _BOX, "compoundPanels": {"orientation": "stacked", "confidence": 1, "first": _BOX, "second": _BOX}, "calibration": _CALIBRATION}
_C, _H, _S = "calibration", "calibration.horizontalScaleEvidence", "leadLabelValidation.semanticRecognition"
_L = lambda *changes: _changed(_LAYOUT, *changes)
#: (issue or null, state of calibration, state of bounds, text)
LAYOUTS = [
    (None, "inferred", "verified", _L()), (None, "unresolved", "unresolved", "{}"), (None, "unresolved", "unresolved", '{"later":[1,{"x":null}]}'), (None, "unresolved", "verified", _L(("calibration.reconciliation", {"quantitativeBlocked": True}))), (None, "inferred", "verified", _L((_C, {"detected": False, "gridScaleDetected": True, "method": "m", "confidence": 0}))),
    (None, "unresolved", "unresolved", _L(("image", _GONE), ("sourceLabelGrid", _GONE), (_C, _GONE), ("contentBox", None), ("compoundPanels", False))), (None, "inferred", "verified", _L(("rowCenters", []), ("leadLabelValidation", _GONE), (_H, _GONE), ("calibration.rowPixelsPerMmX", []))),
    ("malformed_json", None, None, '{"version":1'), ("malformed_json", None, None, ""), ("invalid_object", None, None, "[1]"), ("invalid_object", None, None, "null"), ("unsupported_layout_version", None, None, _L(("version", 2))), ("unsupported_layout_version", None, None, _L(("version", "1"))), ("unsupported_layout_version", None, None, _L(("version", None))),
    ("invalid_object", None, None, _L(("image", [1000, 700]))), ("invalid_image_dimensions", None, None, _L(("image.width", 1000.5))), ("invalid_image_dimensions", None, None, _L(("image.height", "700"))), ("invalid_row_centers", None, None, _L(("rowCenters", [1, "2"]))), ("invalid_row_centers", None, None, _L(("rowCenters", [1, 700]))), ("invalid_row_centers", None, None, _L(("rowCenters", None))), ("invalid_row_centers", None, None, _L(("rowCenters", [-1]))),
    ("invalid_confidence", None, None, _L(("confidence", 1.01))), ("invalid_confidence", None, None, _L(("confidence", True))), ("invalid_object", None, None, _L(("sourceLabelGrid", 5))), ("invalid_source_label_grid", None, None, _L(("layoutHint", "standard_6x2"))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.imageSize", [1000, 701]))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.rowSpacing", 63))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.fontHeight", 27.5))),
    ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.labelRowCenters", [100, 250, 250, 550]))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.slots.5.lead", "V2"))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.slots.3.box", [0, 0, 10.5, 10]))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.rhythmSlot.row", 2))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.anchors.1.lead", "aVR"))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.anchors.0.confidence", 0.64))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.anchors.0.lead", "I"))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.anchors", []))), ("invalid_source_label_grid", None, None, _L(("sourceLabelGrid.maximumXResidual", _GONE))),
    ("invalid_object", None, None, _L(("limbLabelValidation", "x"))), ("invalid_object", None, None, _L((_S, None))), ("invalid_semantic_recognition", None, None, _L((f"{_S}.semanticIdentityConfirmed", False))), ("invalid_semantic_recognition", None, None, _L((f"{_S}.method", ""))), ("invalid_semantic_recognition", None, None, _L((f"{_S}.failureReasons", [1]))), ("invalid_semantic_recognition", None, None, _L((f"{_S}.confidence", -0.1))), ("incomplete_semantic_proof", None, None, _L((f"{_S}.recognizedLabels", ["I"]))), ("incomplete_semantic_proof", None, None, _L((f"{_S}.confidence", 0))), ("incomplete_semantic_proof", None, None, _L((f"{_S}.failureReasons", ["why"]))),
    ("unsubstantiated_semantic_flag", None, None, _L((_S, _GONE))), ("invalid_object", None, None, _L(("contentBox", "all"))), ("invalid_crop", None, None, _L(("contentBox.right", 5))), ("invalid_crop", None, None, _L(("contentBox.bottom", 701))), ("invalid_crop", None, None, _L(("contentBox.top", None))), ("invalid_compound_panels", None, None, _L(("compoundPanels.orientation", "mixed"))), ("invalid_compound_panels", None, None, _L(("compoundPanels.confidence", 1.5))), ("invalid_object", None, None, _L(("compoundPanels.second", _GONE))), ("invalid_crop", None, None, _L(("compoundPanels.first.left", -1))), ("invalid_object", None, None, _L(("compoundPanels", 1))),
    ("invalid_object", None, None, _L((_C, None))), ("invalid_calibration", None, None, _L(("calibration.detected", 1))), ("invalid_calibration", None, None, _L(("calibration.method", ""))), ("invalid_physical_scale", None, None, _L(("calibration.gridScaleMmX", 0))), ("invalid_physical_scale", None, None, _L(("calibration.gainMmPerMv", "10"))), ("invalid_row_scales", None, None, _L(("calibration.rowPixelsPerMmX.0", 0))), ("invalid_row_scales", None, None, _L(("calibration.rowPixelsPerMmX", 4))), ("invalid_object", None, None, _L((_H, 3))), ("invalid_horizontal_scale_evidence", None, None, _L((f"{_H}.rowCount", 12))), ("invalid_horizontal_scale_evidence", None, None, _L((f"{_H}.relativeRange", 0.5))), ("invalid_horizontal_scale_evidence", None, None, _L((f"{_H}.priorPixelsPerMmX", 5))), ("invalid_horizontal_scale_evidence", None, None, _L(("calibration.gridScaleMm", 2))),
    ("unsubstantiated_calibration", None, None, _L(("calibration.gridScaleAmbiguous", True))), ("unsubstantiated_calibration", None, None, _L(("calibration.paperSpeedMmPerSecond", None))), ("unsubstantiated_calibration", None, None, _L(("calibration.pixelsPerMmY", _GONE))),
]

_METRICS = {"evidenceMedian": 0.9, "evidenceP10": 0.4, "coverage": 1, "maxNativeJumpPixels": 9, "p95NativeJumpPixels": 3.5, "sourceStartPixel": 10, "sourceEndPixel": 500, "largeJumpCount": 2}
_NATIVE = {"version": 1, "layout": "standard_3x4", "layoutCost": 0, "effectiveSampleRateHz": 250, "sourceFidelity": {"passed": False, "method": "m", "pixelsPerMm": 4.5, "layoutConfidence": 0.5, "evidenceMedian": 1, "evidenceP10": 0, "minimumCoverage": 0.9, "sourceTimingInference": {"quantitativeCalibrationConfirmed": True, "calibrationPixelsPerMmX": 4, "calibrationPixelsPerMmY": 4, "calibrationConfidence": 0.4, "quantitativeCalibrationMethod": "q"}, "leadMetrics": {"I": _METRICS, "V6": _METRICS}}}
_F, _T, _V6 = "sourceFidelity", "sourceFidelity.sourceTimingInference", "sourceFidelity.leadMetrics.V6"
_N = lambda *changes: _changed(_NATIVE, *changes)
NATIVES = [
    (None, _N()), (None, _N(("version", _GONE), (_T, None))), (None, _N((_T, {}))), (None, _N((f"{_T}.quantitativeCalibrationConfirmed", False), (f"{_T}.calibrationConfidence", 7))), ("malformed_json", "nope"), ("invalid_object", "3"), ("invalid_object", _N((_F, []))), ("invalid_native_fidelity", _N(("layout", "standard_6x2"))), ("invalid_native_fidelity", _N(("version", 3))), ("invalid_native_fidelity", _N(("layoutCost", -1))), ("invalid_native_fidelity", _N(("effectiveSampleRateHz", 0))), ("invalid_native_fidelity", _N((f"{_F}.passed", "yes"))), ("invalid_native_fidelity", _N((f"{_F}.leadMetrics", []))),
    ("invalid_physical_scale", _N((f"{_F}.pixelsPerMm", 0))), ("invalid_object", _N((_T, 4))), ("invalid_timing_confirmation", _N((f"{_T}.quantitativeCalibrationConfirmed", 1))), ("unsubstantiated_timing_confirmation", _N((f"{_T}.calibrationConfidence", 0))), ("unsubstantiated_timing_confirmation", _N((f"{_T}.quantitativeCalibrationMethod", _GONE))), ("invalid_fidelity_fraction", _N((f"{_F}.evidenceP10", 1.5))), ("invalid_fidelity_fraction", _N((f"{_F}.minimumCoverage", _GONE))), ("missing_lead_metrics", _N((f"{_F}.leadMetrics", {}))), ("invalid_lead_id", _N((f"{_F}.leadMetrics.V7", _METRICS))), ("invalid_object", _N((_V6, None))),
    ("invalid_lead_metric", _N((f"{_V6}.coverage", 1.1))), ("invalid_lead_metric", _N((f"{_V6}.sourceStartPixel", "10"))), ("inconsistent_lead_metrics", _N((f"{_V6}.sourceEndPixel", 10))), ("inconsistent_lead_metrics", _N((f"{_V6}.p95NativeJumpPixels", 9.5))), ("invalid_metric_count", _N((f"{_V6}.largeJumpCount", 1.5))), ("invalid_metric_count", _N((f"{_V6}.otherCount", -1))),
]


#: Reports in a part: a row costs far more than its bytes say, so parts follow the rows.
ROWS_IN_PART = 20_000


def _spread(spark, d, table: str, key: str):
    """Keys of a table, dealt evenly."""
    keys = views.read(spark, d, table).select(key)
    return keys.repartition(max(spark.sparkContext.defaultParallelism, -(-keys.count() // ROWS_IN_PART)))


def _text(key: str, cases: list):
    """The text of a row's scenario."""
    return F.element_at(F.array(*(F.lit(c[-1]) for c in cases)), (F.col(key) % len(cases) + 1).cast("int"))


def _said(key: str, cases: list, field: int) -> str:
    return f"CASE {key} % {len(cases)} " + " ".join(f"WHEN {k} THEN {'NULL' if c[field] is None else repr(c[field])}" for k, c in enumerate(cases)) + " END"


@query(f"SELECT p_partkey AS k, CAST({_said('p_partkey', LAYOUTS, 0)} AS VARCHAR) AS issue, CAST({_said('p_partkey', LAYOUTS, 1)} AS VARCHAR) AS calibration, CAST({_said('p_partkey', LAYOUTS, 2)} AS VARCHAR) AS bounds FROM part")
def layout_reports(spark, d):
    return reports.layouts(_spread(spark, d, "part", "p_partkey"), _text("p_partkey", LAYOUTS)).select(F.col("p_partkey").alias("k"), "issue", "calibration", "bounds")


@query(f"SELECT o_orderkey AS k, CAST({_said('o_orderkey', NATIVES, 0)} AS VARCHAR) AS issue FROM orders")
def native_reports(spark, d):
    return reports.natives(_spread(spark, d, "orders", "o_orderkey"), _text("o_orderkey", NATIVES), F.lit("standard_3x4")).select(F.col("o_orderkey").alias("k"), "issue")


_HEX = "lpad(lower(to_hex((CASE WHEN {0} = 0 THEN 0.0::DOUBLE ELSE {0}::DOUBLE END::BIT)::UBIGINT)), 16, '0')"
_NUM = lambda e: f"""'["number","' || {_HEX.format(e)} || '"]'"""
_FIELDS = {"discount": _NUM("l_discount"), "flag": """'["string",' || to_json(l_returnflag) || ']'""", "key": _NUM("l_orderkey"), "late": """'["bool",' || CASE WHEN l_linestatus = 'F' THEN 'true' ELSE 'false' END || ']'""", "none": """'["null"]'""", "price": _NUM("(-l_extendedprice / 7)"), "sizes": f"""'["array",[' || {_NUM("l_linenumber")} || ',' || {_NUM("(l_tax * 0)")} || ',["null"]]]'"""}


@query(f"""SELECT l_orderkey AS run, l_linenumber AS line, sha256('typed-json-finite-f64be-v1' || chr(0) || '["object",[' || {" || ',' || ".join(f"'[' || to_json('{k}') || ',' || {e} || ']'" for k, e in _FIELDS.items())} || ']]') AS proof FROM lineitem""")
def proof_hashes(spark, d):
    c = F.col
    fields = {"price": -c("l_extendedprice") / 7, "key": c("l_orderkey"), "flag": c("l_returnflag"), "late": c("l_linestatus") == "F", "discount": c("l_discount").cast("decimal(12,2)"), "none": F.lit(None), "sizes": F.array(c("l_linenumber").cast("double"), c("l_tax") * 0, F.lit(None).cast("double"))}
    held = views.read(spark, d, "lineitem").select(c("l_orderkey").alias("run"), c("l_linenumber").alias("line"), F.struct(*(v.alias(n) for n, v in fields.items())).alias("v"))
    return held.select("run", "line", proofs.proof_hash(c("v"), held.schema["v"].dataType).alias("proof"))
