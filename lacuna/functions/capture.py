"""What a capture says before tracing: preparation classes, planning context, components, projections and paired grid lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import gates
from lacuna.functions.candidates import holds
from lacuna.plans import policy


def preparation(long_edge: Column, sharpness: Column, trace: Column, grid: Column) -> Column:
    """eligible, and reasons in the order of the record: whether a prepared raster may enter the selection."""
    limit = policy.PREPARATION
    blurred, low = sharpness < limit["sharpness"], long_edge < limit["long_edge"]
    degraded = (trace >= limit["trace"]) & (grid <= limit["weak_grid"])
    smooth = blurred & (trace >= limit["smooth_trace"]) & (grid <= limit["smooth_grid"])
    rejected = blurred & ~smooth
    found = gates.reasons(("blur-rejected", rejected), ("trace-dominant-smooth-source", smooth), ("low-resolution", low), ("foreground-grid-degraded", degraded))
    reasons = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("clean-or-unsupported")))
    return F.struct((~rejected & (low | degraded)).alias("eligible"), reasons.alias("reasons"))


def input_variant(detected: Column, masked_pixels: Column) -> Column:
    """The raster that constrained candidates read."""
    return F.when(detected == "geometry-corrected", "geometry-corrected").when(masked_pixels > 0, "annotation-masked").otherwise("original")


def upscale_target(width: Column, height: Column) -> Column:
    """Pixels that a small source is enlarged to for a native trace; null for others."""
    return F.when(F.greatest(width, height) <= policy.LOW_RESOLUTION["max_edge"], policy.UPSCALE)


def plain_layout(layout: Column, labelled: Column, native_layout: Column, confidence: Column) -> Column:
    """The rectangular layout that is sure enough to plan for, if any."""
    sure = F.coalesce(confidence, F.lit(0.0))
    three = (layout == "standard_3x4") & labelled & (sure >= policy.GEOMETRY_3X4)
    six = (layout == "standard_6x2") & (labelled | holds(native_layout == "standard_6x2")) & (sure >= policy.GEOMETRY_6X2)
    return F.when(holds(three), "standard_3x4").when(holds(six), "standard_6x2")


def in_source(edge: Column, scale: Column, size: Column) -> Column:
    """A component's edge in pixels of the source."""
    return F.least(size, F.greatest(F.lit(0), F.bround(edge / scale, 0).cast("int")))


def project_x(vanishing: Column, x: Column, y: Column, reference_y: Column) -> Column:
    """x where the ray through a point and the vanishing point (x, y, w) meets another height; null at a pole."""
    pole = vanishing["y"] - vanishing["w"] * y
    return F.when(F.abs(pole) > 1e-12, x + (reference_y - y) * (vanishing["x"] - vanishing["w"] * x) / pole)


def paired_lines(x: Column, upper: Column, lower: Column, steps: Column, period: Column, domain: Column) -> Column:
    """status and passed of two grid lines that should be `steps` major periods apart; domain: x0, x1, y0, y1 of the model."""
    middle, gap = (upper + lower) / 2, lower - upper
    inside = (x >= domain["x0"]) & (x < domain["x1"]) & (middle >= domain["y0"]) & (middle < domain["y1"])
    passed = steps.between(1, 4) & (F.bround(gap / period, 0) == steps) & (F.abs(gap - steps * period) <= 2.0)
    status = F.when(upper.isNull() | lower.isNull(), "missing-paired-observation").when(~inside, "outside-model-domain").otherwise("measured")
    return F.struct(status.alias("status"), F.when(status == "measured", passed).otherwise(False).alias("passed"))


def profile_compatibility(gain: Column, known: Column, same_contract: Column, signatures: Column, signature: Column) -> Column:
    """Whether a fitted profile speaks for a candidate: its gain, its contract and its parameters decide, in this order."""
    return F.when(holds(gain != 10), "incompatible").when(~known, "historical_unverified").when(same_contract & holds(F.array_contains(signatures, signature)), "compatible").otherwise("incompatible")


def keeps_source_geometry(source_variant: Column, native: Column, usable: Column, block: Column, corrected_variant: Column, corrected_space: Column) -> Column:
    """A calibrated original raster isn't given up for a rectified one."""
    return holds((source_variant == "original") & native & usable & block.isNull() & (corrected_variant == "geometry-corrected") & (corrected_space == "geometry-corrected"))
