"""Contracts of the reports of layout detection and of native extraction, over their JSON as VARIANT.

`layout_rules` and `native_rules` list (code, rule) in the order in which a report is read; the first broken one is its issue.
Fields that are absent are left alone where the record may lack them; a field of the wrong type breaks its rule. Of the source
label grid the frame, the slots and the anchors are checked, not the tokens of its local and tiled recognition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import variants as V
from lacuna.functions.contracts import LEADS
from lacuna.operators.ranges import fixed
from lacuna.plans import policy

# fixed values: words and limits of the published reports
VALIDATIONS = ["leadLabelValidation", "precordialLabelValidation", "limbLabelValidation", "rhythmLeadValidation"]
SCALES = ["gridScaleMm", "gridScaleMmX", "gridScaleMmY", "gridSpacingXPixels", "gridSpacingYPixels", "paperSpeedMmPerSecond", "gainMmPerMv", "pixelsPerMmX", "pixelsPerMmY"]
NEEDED_SCALES = ["pixelsPerMmX", "pixelsPerMmY", "paperSpeedMmPerSecond", "gainMmPerMv"]
GRID_METHODS = {"method": "source-value-grid-below-trace-v1", "maskMethod": "maximum-channel-below-160-v1"}
ROW_MEDIAN = "consistent-row-grid-median-v1"
FRACTIONS = ["layoutConfidence", "evidenceMedian", "evidenceP10", "minimumCoverage"]
LEAD_FRACTIONS = ["evidenceMedian", "evidenceP10", "coverage"]
LEAD_MEASURES = ["maxNativeJumpPixels", "p95NativeJumpPixels", "sourceStartPixel", "sourceEndPixel"]

Rules = list[tuple[str, Column]]


def _absent_or(v: Column, path: str, rule: Column) -> Column:
    return ~V.given(v, path) | V.yes(rule)


def _is(v: Column, path: str, kind: str) -> Column:
    return V.yes(V.kind(v, path) == kind)


def _positive(v: Column, path: str) -> Column:
    return V.yes(V.number(v, path) > 0)


def _not_negative(v: Column, path: str) -> Column:
    return V.yes(V.number(v, path) >= 0)


def _fraction(v: Column, path: str) -> Column:
    return V.yes(V.number(v, path).between(0, 1))


def _filled(v: Column, path: str) -> Column:
    """Whether a field is there and neither null, false, zero nor empty text."""
    return V.yes(V.kind(v, path).isin("object", "array")) | V.yes(V.boolean(v, path)) | V.yes(V.number(v, path) != 0) | V.yes(F.length(V.string(v, path)) > 0)


def _within(v: Column, path: str, image: Column) -> Column:
    """A box of four numbers with an area, inside of the image if there is one."""
    left, top, right, bottom = (V.number(v, f"{path}.{k}") for k in ("left", "top", "right", "bottom"))
    frame = ~image | ((right <= F.col("_width")) & (bottom <= F.col("_height")))
    return V.yes((left >= 0) & (top >= 0) & (right > left) & (bottom > top) & frame)


def _box(v: Column, path: str, image: Column, when: Column) -> Rules:
    return [("invalid_object", ~when | _is(v, path, "object")), ("invalid_crop", ~when | _within(v, path, image))]


def _recognition(v: Column, path: str) -> Rules:
    """Rules of a label validation and the semantic recognition in it."""
    own = f"{path}.semanticRecognition"
    there, confidence, reasons = V.given(v, own), V.number(v, f"{own}.confidence"), V.strings(v, f"{own}.failureReasons")
    wanted, found = V.strings(v, f"{own}.expectedLabels"), V.strings(v, f"{own}.recognizedLabels")
    passed = V.boolean(v, f"{own}.passed")
    sound = V.yes((passed == V.boolean(v, f"{own}.semanticIdentityConfirmed")) & (F.length(V.string(v, f"{own}.method")) > 0)) & _fraction(v, f"{own}.confidence") & reasons.isNotNull() & _absent_or(v, f"{own}.expectedLabels", wanted.isNotNull()) & _absent_or(v, f"{own}.recognizedLabels", found.isNotNull())
    proof = V.yes((V.string(v, f"{own}.order") == "standard") & (confidence > 0) & (wanted == found) & (F.size(reasons) == 0))
    return [
        ("invalid_object", _absent_or(v, path, V.kind(v, path) == "object")), ("invalid_object", ~there | _is(v, own, "object")), ("invalid_semantic_recognition", ~there | sound), ("incomplete_semantic_proof", ~there | ~V.yes(passed) | proof),
        ("unsubstantiated_semantic_flag", there | ~V.yes(V.boolean(v, f"{path}.semanticIdentityConfirmed"))),
    ]


def _label_grid(v: Column) -> Column:
    """The frame of a source label grid, its twelve slots, the rhythm slot and its anchors."""
    g, width, height = "$.sourceLabelGrid", F.col("_width"), F.col("_height")
    row, column, font = (V.number(v, f"{g}.{k}") for k in ("rowSpacing", "columnSpacing", "fontHeight"))
    share = policy.LABEL_GRID
    between = lambda x, limits, of: (x > of * F.lit(limits[0])) & (x < of * F.lit(limits[1]))
    rising = lambda rows: (F.size(rows) == 4) & F.forall(F.sequence(F.lit(1), F.lit(3)), lambda i: F.get(rows, i) > F.get(rows, i - 1)) & F.forall(rows, lambda y: (y >= 0) & (y < height))
    frame = F.col("_image") & (V.string(v, "$.layoutHint") == "standard_3x4_with_r1") & (V.number(v, f"{g}.version") == 1) & (V.numbers(v, f"{g}.imageSize") == F.array(width, height)) & between(row, share["rows"], height) & between(column, share["columns"], width) & between(font, share["font"], row) & (F.size(V.numbers(v, f"{g}.xFit")) == 3) & (F.size(V.numbers(v, f"{g}.yFit")) == 3) & V.let(V.numbers(v, f"{g}.labelRowCenters"), rising) & _not_negative(v, f"{g}.maximumXResidual") & _not_negative(v, f"{g}.maximumYResidual")
    for key, word in GRID_METHODS.items():
        frame = frame & (V.string(v, f"{g}.{key}") == word)

    def slot(s: Column, lead: Column, row_: Column, column_: Column) -> Column:
        inside = lambda b: (F.size(b) == 4) & F.forall(b, V.whole) & (b[0] >= 0) & (b[1] >= 0) & (b[2] > b[0]) & (b[3] > b[1]) & (b[2] <= width) & (b[3] <= height)
        return V.yes((V.string(s, "$.lead") == lead) & (V.number(s, "$.row") == row_) & (V.number(s, "$.column") == column_) & V.let(V.numbers(s, "$.box"), inside))

    places = F.array(*(F.struct(F.lit(n).alias("lead"), F.lit(r).alias("row"), F.lit(k).alias("column")) for r, line in enumerate(policy.LABEL_ROWS) for k, n in enumerate(line)))
    filled = F.forall(F.zip_with("_slots", places, lambda s, p: slot(s, p["lead"], p["row"], p["column"])), lambda ok: ok) & slot(F.try_variant_get(v, f"{g}.rhythmSlot", "variant"), F.lit("II"), F.lit(3), F.lit(0))
    allowed = F.array(*(F.lit(n) for line in policy.LABEL_ROWS for k, n in enumerate(line) if k))
    anchor = lambda a: V.yes(F.array_contains(allowed, V.string(a, "$.lead")) & V.number(a, "$.confidence").between(0.65, 1) & (V.number(a, "$.x") >= 0) & (V.number(a, "$.y") >= 0) & (V.number(a, "$.width") > 0) & (V.number(a, "$.height") > 0) & (V.number(a, "$.x") + V.number(a, "$.width") <= width) & (V.number(a, "$.y") < height))
    leads = F.transform("_anchors", lambda a: V.string(a, "$.lead"))
    return V.yes(frame) & V.yes((F.size("_slots") == 12) & filled) & V.yes(F.size("_anchors").between(6, 9) & (F.size(F.array_distinct(leads)) == F.size("_anchors")) & F.forall("_anchors", anchor))


def _row_scales(v: Column) -> Column:
    """The horizontal scale follows the median of six or twelve row scales that hardly differ."""
    own, c = "$.calibration.horizontalScaleEvidence", "$.calibration"
    rows = F.col("_scales")
    n = F.size(rows)
    center = (F.get(rows, F.floor((n - 1) / 2).cast("int")) + F.get(rows, F.floor(n / 2).cast("int"))) / 2
    spread, prior = (F.element_at(rows, -1) - F.get(rows, F.lit(0))) / center, V.number(v, f"{own}.priorPixelsPerMmX")
    spread = F.when(n > 0, spread)
    scale = F.coalesce(V.number(v, f"{c}.gridScaleMmX"), V.number(v, f"{c}.gridScaleMm"))
    return V.yes(n.isin(6, 12) & (V.number(v, f"{own}.version") == 1) & (V.string(v, f"{own}.method") == ROW_MEDIAN) & (prior > 0) & F.forall(rows, lambda x: x.between(1, 40)) & (V.number(v, f"{own}.rowCount") == n) & (V.number(v, f"{own}.relativeRange") >= 0) & (F.abs(V.number(v, f"{own}.relativeRange") - spread) <= 1e-9) & (spread <= 0.02) & (F.abs(V.number(v, f"{c}.pixelsPerMmX") - center) <= 1e-9) & (F.abs(center - prior) / F.greatest(center, prior) <= 0.15) & V.boolean(v, f"{c}.detected") & (V.number(v, f"{c}.confidence") >= 0.35) & scale.isin(1.0, 5.0))


def layout_rules(v: Column) -> Rules:
    """Rules over a report and what `layouts` has taken out of it."""
    image, rows = F.col("_image"), F.col("_rows")
    rules: Rules = [("malformed_json", v.isNotNull()), ("invalid_object", _is(v, "$", "object")), ("unsupported_layout_version", _absent_or(v, "$.version", V.number(v, "$.version") == 1)), ("invalid_object", ~image | _is(v, "$.image", "object"))]
    rules += [("invalid_image_dimensions", ~image | (_positive(v, "$.image.width") & V.whole(V.number(v, "$.image.width")) & _positive(v, "$.image.height") & V.whole(V.number(v, "$.image.height"))))]
    rules += [("invalid_row_centers", _absent_or(v, "$.rowCenters", rows.isNotNull() & F.forall(rows, lambda y: (y >= 0) & (~image | (y < F.col("_height"))))))]
    rules += [("invalid_confidence", _absent_or(v, "$.confidence", _fraction(v, "$.confidence")))]
    rules += [("invalid_object", _absent_or(v, "$.sourceLabelGrid", V.kind(v, "$.sourceLabelGrid") == "object")), ("invalid_source_label_grid", _absent_or(v, "$.sourceLabelGrid", _label_grid(v)))]
    for name in VALIDATIONS:
        rules += _recognition(v, f"$.{name}")
    rules += _box(v, "$.contentBox", image, _filled(v, "$.contentBox"))
    panels = _filled(v, "$.compoundPanels")
    rules += [("invalid_object", ~panels | _is(v, "$.compoundPanels", "object")), ("invalid_compound_panels", ~panels | (V.yes(V.string(v, "$.compoundPanels.orientation").isin("side_by_side", "stacked")) & _fraction(v, "$.compoundPanels.confidence")))]
    rules += _box(v, "$.compoundPanels.first", image, panels) + _box(v, "$.compoundPanels.second", image, panels)
    c = "$.calibration"
    there, detected = V.given(v, c), V.yes(V.boolean(v, f"{c}.detected"))
    rules += [("invalid_object", ~there | _is(v, c, "object")), ("invalid_calibration", ~there | (V.boolean(v, f"{c}.detected").isNotNull() & V.yes(F.length(V.string(v, f"{c}.method")) > 0) & _fraction(v, f"{c}.confidence")))]
    rules += [("invalid_physical_scale", ~there | V.yes(V.kind(v, f"{c}.{key}") == "null") | _absent_or(v, f"{c}.{key}", _positive(v, f"{c}.{key}"))) for key in SCALES]
    rules += [("invalid_row_scales", _absent_or(v, f"{c}.rowPixelsPerMmX", F.forall("_scales", lambda x: x > 0)))]
    rules += [("invalid_object", _absent_or(v, f"{c}.horizontalScaleEvidence", V.kind(v, f"{c}.horizontalScaleEvidence") == "object")), ("invalid_horizontal_scale_evidence", _absent_or(v, f"{c}.horizontalScaleEvidence", _row_scales(v)))]
    full = V.yes(V.number(v, f"{c}.confidence") > 0) & ~V.yes(V.boolean(v, f"{c}.gridScaleAmbiguous"))
    for key in NEEDED_SCALES:
        full = full & _positive(v, f"{c}.{key}")
    return [*rules, ("unsubstantiated_calibration", ~detected | full)]


def layouts(df: DataFrame, text: Column) -> DataFrame:
    """df with issue (null if the report keeps its rules), calibration and bounds (states of its evidence, if so)."""
    v, c = F.col("_report"), "$.calibration"
    taken = {"_image": V.given(v, "$.image"), "_width": V.number(v, "$.image.width"), "_height": V.number(v, "$.image.height"), "_rows": V.numbers(v, "$.rowCenters"), "_slots": V.items(v, "$.sourceLabelGrid.slots"), "_anchors": V.items(v, "$.sourceLabelGrid.anchors"), "_scales": F.array_sort(V.numbers(v, f"{c}.rowPixelsPerMmX"))}
    read = fixed(fixed(df, _report=V.parsed(text)), **taken)
    inferred = (V.yes(V.boolean(v, f"{c}.detected")) | V.yes(V.boolean(v, f"{c}.gridScaleDetected"))) & ~_filled(v, f"{c}.reconciliation.quantitativeBlocked")
    judged = fixed(read, issue=V.first_issue(layout_rules(v)), _inferred=inferred)
    sound = F.col("issue").isNull()
    calibration = F.when(F.col("_inferred"), "inferred").otherwise("unresolved")
    bounds = F.when(F.col("_image"), "verified").otherwise("unresolved")
    return judged.select(*df.columns, "issue", F.when(sound, calibration).alias("calibration"), F.when(sound, bounds).alias("bounds"))


def natives(df: DataFrame, text: Column, layout: Column) -> DataFrame:
    """df with the issue of its native reports."""
    read = fixed(df, _report=V.parsed(text), _layout=layout)
    return read.select(*df.columns, V.first_issue(native_rules(F.col("_report"), F.col("_layout"))).alias("issue"))


def native_rules(v: Column, layout: Column) -> Rules:
    """Rules of a native extraction report for the layout that was asked for."""
    f, t = "$.sourceFidelity", "$.sourceFidelity.sourceTimingInference"
    shape = (V.string(v, "$.layout") == layout) & _absent_or(v, "$.version", V.number(v, "$.version") == 1) & _not_negative(v, "$.layoutCost") & _positive(v, "$.effectiveSampleRateHz") & V.boolean(v, f"{f}.passed").isNotNull() & V.string(v, f"{f}.method").isNotNull() & _is(v, f"{f}.leadMetrics", "object")
    rules: Rules = [("malformed_json", v.isNotNull()), ("invalid_object", _is(v, "$", "object")), ("invalid_object", _is(v, f, "object")), ("invalid_native_fidelity", shape), ("invalid_physical_scale", _positive(v, f"{f}.pixelsPerMm"))]
    timed, said = V.given(v, t) & ~V.yes(V.kind(v, t) == "null"), V.boolean(v, f"{t}.quantitativeCalibrationConfirmed")
    proof = _positive(v, f"{t}.calibrationPixelsPerMmX") & _positive(v, f"{t}.calibrationPixelsPerMmY") & _fraction(v, f"{t}.calibrationConfidence") & V.yes(V.number(v, f"{t}.calibrationConfidence") > 0) & V.yes(F.length(V.string(v, f"{t}.quantitativeCalibrationMethod")) > 0)
    rules += [("invalid_object", ~timed | _is(v, t, "object")), ("invalid_timing_confirmation", ~timed | _absent_or(v, f"{t}.quantitativeCalibrationConfirmed", said.isNotNull())), ("unsubstantiated_timing_confirmation", ~timed | ~V.yes(said) | proof)]
    rules += [("invalid_fidelity_fraction", _fraction(v, f"{f}.{key}")) for key in FRACTIONS]
    leads = F.try_variant_get(v, f"{f}.leadMetrics", "map<string,variant>")
    rules += [("missing_lead_metrics", V.yes(F.size(leads) > 0)), ("invalid_lead_id", F.forall(F.map_keys(leads), lambda k: k.isin(LEADS)))]
    metrics = F.map_values(leads)
    all_of = lambda rule: F.forall(metrics, lambda m: V.yes(rule(m)))
    fields = lambda m: F.map_entries(F.try_variant_get(m, "$", "map<string,variant>"))
    measured = lambda m: F.forall(F.array(*(_fraction(m, f"$.{k}") for k in LEAD_FRACTIONS), *(_not_negative(m, f"$.{k}") for k in LEAD_MEASURES)), lambda ok: ok)
    ordered = lambda m: (V.number(m, "$.sourceEndPixel") > V.number(m, "$.sourceStartPixel")) & (V.number(m, "$.p95NativeJumpPixels") <= V.number(m, "$.maxNativeJumpPixels"))
    counted = lambda m: F.forall(fields(m), lambda e: ~e["key"].endswith("Count") | (V.whole(V.number(e["value"], "$")) & V.yes(V.number(e["value"], "$") >= 0)))
    return [*rules, ("invalid_object", all_of(lambda m: V.kind(m) == "object")), ("invalid_lead_metric", all_of(measured)), ("inconsistent_lead_metrics", all_of(ordered)), ("invalid_metric_count", all_of(counted))]
