"""What a candidate's own record says, as Column expressions on the columns of a candidate table.

A candidate has run, id, status, layout (normalised name), with_rhythm, kind, variant, vectorizer, label_thresh, constraint,
crop, canonical, dark_ink, eligible, adaptive, confirmed, artifact_ok, geometry_confidence, semantic (struct-like columns
semantic_confirmed, semantic_order, semantic_method, semantic_layout), timing_confirmed and the source fidelity (method,
passed, layout_confidence, evidence_median, evidence_p10, minimum_coverage, home_row, anchors, rhythm_passed, excursions,
jumps, maximum_jumps, order_passed, selected_order, label_passed, label_order, precordial_passed, panel_timing, row_timing,
recovery). A null method means that there is no source fidelity. Nulls never satisfy a rule.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.plans import policy

# fixed values: names of the published record
DERIVED = ["panel-composite", "peer-gap-repair", "lead-fusion"]
PREPROCESSED = ["preprocessed", "geometry-corrected", "artifact-preprocessed"]
ANNOTATION_SAFE = ["annotation-masked", *PREPROCESSED]
REVIEW_LAYOUTS = ["standard_6x2", "standard_6x2_with_r1_ignored", "standard_3x4", "standard_3x4_with_r1", "standard_3x4_with_r2", "standard_3x4_with_r3", "cabrera_12x1", "standard_12x1"]
LIMB_LAYOUTS = ["standard_6x1_limb", "cabrera_6x1_limb"]
FULL_LAYOUTS = ["standard_3x4", "standard_6x2", "standard_12x1", "cabrera_12x1"]
COMPOUND = "row-local-compound-label-and-algebra-v1"
UNVERIFIED = "row-local-twelve-lead-unverified-v2"
SIX_BY_TWO = "row-local-labeled-six-by-two-algebra-validated-v1"
SEQUENTIAL = ["row-local-sequential-label-validated-v2", "row-local-sequential-label-validated-v3"]
ANCHORED = "row-local-calibration-anchored-six-by-two-v1"
RHYTHM = "rhythm-anchored-label-validated-three-by-four-v1"
RECOVERY = "near-continuous-vertical-source-ink-v1"


def holds(rule: Column) -> Column:
    """A rule that a null doesn't satisfy."""
    return F.coalesce(rule, F.lit(False))


def kind() -> Column:
    """The recorded kind, or else the first that the parameters imply."""
    c = F.col
    return F.coalesce("kind", F.when(c("vectorizer") == "native-grid-path", "native-grid").when(c("crop").isNotNull(), "crop-proposal").when(c("constraint").isNotNull(), "geometry-constrained").when(c("variant") == "preprocessed", "adaptive-preprocessed").otherwise("source-model"))


def derived() -> Column:
    return kind().isin(DERIVED)


def native_grid() -> Column:
    return holds(F.col("vectorizer") == "native-grid-path")


def preprocessed() -> Column:
    return holds(F.col("variant").isin(PREPROCESSED))


def source_pixels() -> Column:
    return native_grid() | holds((F.col("vectorizer") == "dynamic-path") & F.col("dark_ink"))


def capabilities() -> Column:
    """derived, native_grid, preprocessed, geometry_constrained, source_pixels, eligible, in the order of the record."""
    return F.struct(derived().alias("derived"), native_grid().alias("native_grid"), preprocessed().alias("preprocessed"), F.col("constraint").isNotNull().alias("geometry_constrained"), source_pixels().alias("source_pixels"), F.coalesce("eligible", F.lit(True)).alias("eligible"))


def annotation_safe() -> Column:
    return holds(F.col("variant").isin(ANNOTATION_SAFE))


def permissive() -> Column:
    return holds(F.col("label_thresh") < policy.CONSERVATIVE_THRESHOLD)


def unverified_panel_timing() -> Column:
    return native_grid() & F.col("layout").isin("standard_3x4", "standard_12x1") & ~holds(F.col("panel_timing")) & ~holds(F.col("row_timing"))


def timing_state() -> Column:
    """not_applicable without an inference, verified if it confirms its units, or else unresolved."""
    return F.when(F.col("timing_confirmed").isNull(), "not_applicable").when(F.col("timing_confirmed"), "verified").otherwise("unresolved")


def sampling_risk(lead_jumps: Column) -> Column:
    return native_grid() & holds(F.col("recovery") == RECOVERY) & holds(lead_jumps > 0)


def expected_order() -> Column:
    return F.when(F.col("layout").startswith("cabrera"), "cabrera").otherwise("standard")


def explicit_identity() -> Column:
    """Printed labels prove the names of the leads."""
    c = F.col
    labels = c("semantic_confirmed") & (c("semantic_order") == expected_order()) & (F.length("semantic_method") > 0) & (c("semantic_layout").isNull() | (c("semantic_layout") == c("layout")))
    order = c("layout").isin(LIMB_LAYOUTS) & c("order_passed") & (c("selected_order") == expected_order())
    return c("layout").isin(FULL_LAYOUTS + LIMB_LAYOUTS) & (holds(labels) | holds(order))


def provisional_identity() -> Column:
    """A confirmed layout of a native trace stands in for labels."""
    c = F.col
    return ~explicit_identity() & holds(c("layout").isin(FULL_LAYOUTS) & (c("constraint") == c("layout")) & native_grid() & c("confirmed") & (c("geometry_confidence") >= policy.REVIEW_LAYOUT) & (c("layout_confidence") >= policy.REVIEW_LAYOUT))


def boundary_layout() -> Column:
    """The source fidelity validates the layout that boundary leads rely on, by its method."""
    c = F.col
    order, label, precordial = holds(c("order_passed")), holds(c("label_passed")), holds(c("precordial_passed"))
    rhythm = holds((c("anchors") >= 3) & c("rhythm_passed"))
    known = F.when(c("method") == COMPOUND, order & precordial).when(c("method") == UNVERIFIED, order).when(c("method") == SIX_BY_TWO, order & precordial).when(c("method").isin(SEQUENTIAL), order & label).when(c("method") == ANCHORED, c("layout_confidence") >= 0.8)
    known = known.when(c("method") == RHYTHM, label & holds(c("label_order") == "standard") & rhythm & (c("layout_confidence") >= 0.35))
    return c("method").isNotNull() & holds(known.otherwise(c("with_rhythm") & rhythm & (c("layout_confidence") >= 0.75)))


def review_layout() -> Column:
    """The layout is the one asked for, and a native trace that failed its fidelity is at least good enough to review.

    The rules of a single weak lead and of a connected rhythm need all leads: see `trust.supported_layouts`.
    """
    c = F.col
    asked = holds(c("constraint").isin(REVIEW_LAYOUTS) & (F.concat("layout", F.when(c("with_rhythm"), "_with_r1").otherwise("")) == c("constraint")))
    weak = native_grid() & c("method").isNotNull() & ~holds(c("passed"))
    enough = (c("layout_confidence") >= policy.NATIVE_LAYOUT) & (c("evidence_median") >= policy.NATIVE_MEDIAN) & (c("evidence_p10") >= policy.NATIVE_P10) & (c("minimum_coverage") >= policy.REVIEWABLE) & (F.coalesce("home_row", F.lit(1.0)) >= 0.55)
    return asked & (~weak | holds(enough))


def ineligible() -> Column:
    """Why a candidate can't be selected; null if it can."""
    c = F.col
    return (
        F.when(~F.coalesce(c("eligible"), F.lit(True)), "capability-ineligible")
        .when(unverified_panel_timing(), "native-panel-timing-unverified")
        .when(holds(c("variant") == "preprocessed") & ~holds(c("adaptive")) & ~holds(c("confirmed")), "preprocessing-unconfirmed")
        .when(holds(c("variant") == "artifact-preprocessed") & ~holds(c("artifact_ok")), "artifact-preprocessing-unconfirmed")
        .when(native_grid() & preprocessed() & ~holds(c("passed")), "preprocessed-native-fidelity-failed")
    )


# of a lead: expected, finite, outside, errors, unbroken (no gap between its first and last sample), lead_excursions


def _reaches(share: float) -> Column:
    least = F.least("expected", F.greatest(F.lit(policy.MIN_SAMPLES), F.ceil(F.col("expected") * F.lit(share))))
    return (F.col("expected") > 0) & (F.col("finite") >= least)


def complete_lead() -> Column:
    return holds(_reaches(policy.PUBLISHABLE) & (F.col("errors") == 0))


def backed_boundaries() -> Column:
    """What a candidate must show for its leads to count though their ends are cut off."""
    c = F.col
    return holds(c("canonical") & c("passed") & boundary_layout() & (c("minimum_coverage") >= policy.BOUNDARY) & (F.coalesce("excursions", F.lit(0)) == 0))


def whole_boundary() -> Column:
    """What such a lead must show itself: nothing missing inside, no unsafe excursion."""
    c = F.col
    return holds(_reaches(policy.BOUNDARY) & (c("outside") == 0) & (c("errors") == 0) & (F.coalesce("lead_excursions", F.lit(0)) == 0) & c("unbroken"))


def boundary_lead() -> Column:
    """A lead whose ends are cut off, backed by source fidelity: nothing missing inside, no unsafe excursion."""
    return backed_boundaries() & whole_boundary()


def covered_lead() -> Column:
    return holds((F.col("expected") > 0) & (F.col("finite") >= F.ceil(F.col("expected") * F.lit(policy.REVIEWABLE))))


def reviewable_lead() -> Column:
    return covered_lead() & holds(F.col("outside") == 0)


# leads as bits: lead k of a candidate is bit k of a long, so sets of leads are joined and met by | and &


def lead_bit(lead: Column | str = "lead") -> Column:
    """The bit of a lead's number, 0 to 62; null of null."""
    number = F.col(lead) if isinstance(lead, str) else lead
    return F.when(number.between(0, 62), F.call_function("shiftleft", F.lit(1).cast("long"), number.cast("int"))).when(number.isNotNull(), F.raise_error(F.concat(F.lit("lead beyond 0 to 62: "), number.cast("string"))).cast("long"))


def agreeing(rmse: list[Column]) -> Column:
    """Bits of the leads of a pair that agree; rmse: of lead 0, 1 and so on."""
    return reduce(lambda x, y: x.bitwiseOR(y), (F.when(v <= policy.DISAGREEMENT, F.lit(1 << k).cast("long")).otherwise(F.lit(0).cast("long")) for k, v in enumerate(rmse)))
