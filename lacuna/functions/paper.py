"""Printed paper: settings, grid scale, timing gates, row bounds, panel margins, crops and source regions, as Column expressions.

Nulls stand for values that were not measured; a rule never holds on one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lacuna.functions import geometry
from lacuna.functions.candidates import holds

# fixed values: settings and limits of the published calibration
SPEEDS = [25.0, 50.0]
GAINS = [5.0, 10.0, 20.0]
GRID_MM = [1.0, 5.0]
AGREEMENT = 0.12
LEAST_CONFIDENCE = 0.35
SAMPLE_RATE = 500
SECONDS = 10


def pixels_per_mm(period: Column, scale_mm: Column) -> Column:
    """Of a grid whose physical period is known; null if it isn't."""
    return F.when(~F.isnan(period) & (period > 0) & (period < float("inf")) & scale_mm.isin(GRID_MM), period / scale_mm)


def timing_scale(rows: Column, calibrated: Column, period: Column, scale_mm: Column, prefer_raw: Column) -> Column:
    """Pixels for a millimetre of time: of the rows (an array), of the raw grid, or the calibrated one."""
    raw = pixels_per_mm(period, scale_mm)
    return F.when(~prefer_raw, F.when(F.size(rows) == 6, F.array_min(rows)).otherwise(calibrated)).when(raw.between(1.0, 40.0), raw).otherwise(calibrated)


def row_spread(rows: Column) -> Column:
    """Range of an array of six or twelve row scales as a share of their median."""
    ordered = F.array_sort(rows)
    middle = (F.element_at(ordered, (F.size(rows) / 2).cast("int")) + F.element_at(ordered, (F.size(rows) / 2).cast("int") + 1)) / 2
    return F.when(F.size(rows).isin(6, 12), (F.array_max(rows) - F.array_min(rows)) / middle)


def speed_resolved(speed: Column, printed: Column, gain: Column, printed_gain: Column, confidence: Column, rows: Column, x: Column, y: Column, pulse_mm: Column) -> Column:
    """A printed speed of 50 stands against a pulse read at 25: repeated rows agree, axes agree, and the pulse is half as wide."""
    alike = lambda a, b, limit: F.abs(a - b) / F.greatest(a, b) <= limit
    return holds((speed == 25) & (printed == 50) & gain.isin(GAINS) & (printed_gain == gain) & confidence.between(LEAST_CONFIDENCE, 1.0) & F.forall(rows, lambda r: r.between(1.0, 40.0)) & (row_spread(rows) <= 0.02) & alike(x, y, 0.05) & pulse_mm.between(4.5, 5.5))


def settings_state(detected: Column, speed: Column, gain: Column, printed_speed: Column, printed_gain: Column, conflict: Column) -> Column:
    """unsupported, conflict, confirmed (a printed value agrees), or not_compared; a printed null was not read."""
    near = lambda a, b: F.abs(a - b) <= 0.01 * F.greatest(F.abs(a), F.abs(b))
    unsupported = holds(~printed_speed.isin(SPEEDS)) | holds(~printed_gain.isin(GAINS))
    apart = detected & (holds(~near(printed_speed, speed)) | holds(~near(printed_gain, gain)))
    compared = detected & (printed_speed.isNotNull() | printed_gain.isNotNull())
    return F.when(unsupported, "unsupported").when(conflict | apart, "conflict").when(compared, "confirmed").otherwise("not_compared")


def confirms_source_timing(detected: Column, confidence: Column, scale_mm: Column, inferred_scale_mm: Column, error: Column, x: Column, y: Column, inferred: Column, speed: Column, gain: Column, pulse_start: Column, pulse_end: Column) -> Column:
    """Pulse and grid calibration agrees with the timing inferred from the source span."""
    near = lambda p: (F.abs(inferred - p) / p <= AGREEMENT) & p.between(1.0, 40.0)
    return holds(detected & (confidence >= LEAST_CONFIDENCE) & scale_mm.isin(GRID_MM) & (inferred_scale_mm == scale_mm) & (error <= AGREEMENT) & near(x) & near(y) & inferred.between(1.0, 40.0) & speed.isin(SPEEDS) & gain.isin(GAINS) & (pulse_end > pulse_start))


def global_fallback(ranges: Column, accepted: Column, grid_detected: Column, scale_mm: Column) -> Column:
    """Global timing may stand in: no row ranges, no refusal, and a grid that is known."""
    return ranges.isNull() & F.coalesce(accepted, F.lit(True)) & (F.coalesce(grid_detected, F.lit(False)) | scale_mm.isNotNull())


def panel_margins(width: Column, column: Column, columns: Column) -> Column:
    """(start, end) of a panel's edges that labels may cover."""
    part = lambda share, least: F.greatest(F.lit(least), F.bround(width * share, 0).cast("int"))
    two = F.struct(part(F.when(column == 1, 0.082).otherwise(0.041), 3).alias("start"), part(F.lit(0.008), 2).alias("end"))
    many = F.struct(F.when(column == 0, part(F.lit(0.045), 3)).otherwise(0).alias("start"), F.when(column == columns - 1, part(F.lit(0.014), 2)).otherwise(0).alias("end"))
    return F.when(columns == 2, two).otherwise(many)


def six_row_bounds(centers: Column, height: Column) -> Column:
    """(top, bottom) of six rows: halfway between centres, 0.48 of the median spacing beyond the outer ones; centers: six doubles."""
    gaps = F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.element_at(centers, i + 1) - F.element_at(centers, i)))
    reach = F.element_at(gaps, 3) * 0.48
    edge = lambda i: F.when(i == 0, centers[0] - reach).when(i == 6, centers[5] + reach).otherwise((F.get(centers, i - 1) + F.get(centers, i)) / 2)
    return F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct(F.greatest(F.lit(0), F.bround(edge(i), 0).cast("int")).alias("top"), F.least(height, F.bround(edge(i + 1), 0).cast("int")).alias("bottom")))


def sequential_row_bounds(centers: Column, height: Column, reach: float = 0.82) -> Column:
    """(top, bottom) of each row: `reach` of the spacing to its neighbour on either side."""
    n = F.size(centers)

    def bound(c: Column, i: Column) -> Column:
        above = F.when(i > 0, c - F.get(centers, i - 1)).otherwise(F.get(centers, F.lit(1)) - F.get(centers, F.lit(0)))
        below = F.when(i < n - 1, F.get(centers, i + 1) - c).otherwise(F.get(centers, n - 1) - F.get(centers, n - 2))
        return F.struct(F.greatest(F.lit(0), F.bround(c - above * reach, 0).cast("int")).alias("top"), F.least(height, F.bround(c + below * reach, 0).cast("int")).alias("bottom"))

    return F.when(n >= 2, F.transform(centers, bound))


def effective_rate(width: Column, height: Column, resample: Column) -> Column:
    """Samples a second that a source of this size can carry."""
    return F.least(F.lit(float(SAMPLE_RATE)), F.least(F.greatest(width, height), resample) / float(SECONDS))


def two_panel_crops(width: Column, height: Column, centers: Column) -> Column:
    """Crops (left, top, right, bottom) of the halves of a page of six by two leads, overlapping in the middle."""
    up = lambda x: F.floor(x + 0.5).cast("int")
    bottom = F.when(F.size(centers) >= 7, F.least(F.greatest(up((F.get(centers, F.lit(5)) + F.get(centers, F.lit(6))) / 2), F.lit(1)), height)).otherwise(up(height * 0.84))
    overlap, split = F.greatest(F.lit(4), up(width * 0.025)), up(width / 2)
    return F.array(F.struct(F.lit(0).alias("left"), F.lit(0).alias("top"), F.least(width, split + overlap).alias("right"), bottom.alias("bottom")), F.struct(F.greatest(F.lit(0), split - overlap).alias("left"), F.lit(0).alias("top"), width.alias("right"), bottom.alias("bottom")))


def composite_crops(left: Column, top: Column, right: Column, bottom: Column) -> Column:
    """Upper and lower crops of a page that is nearly square and tall enough to hold two panels, none otherwise."""
    height, middle = bottom - top, F.floor((top + bottom) / 2 + 0.5).cast("int")
    overlap = F.greatest(F.lit(8), F.floor(height * 0.04 + 0.5).cast("int"))
    box = lambda t, b: F.struct(left.alias("left"), t.alias("top"), right.alias("right"), b.alias("bottom"))
    tall = ((right - left) / F.greatest(height, F.lit(1)) < 1.35) & (height >= 480)
    return F.when(tall, F.array(box(top, F.least(bottom, middle + overlap)), box(F.greatest(top, middle - overlap), bottom))).otherwise(F.array().cast("array<struct<left:int,top:int,right:int,bottom:int>>"))


def working_size(space: Column, corrected: Column, working: Column, source: Column) -> Column:
    """Width or height of the raster that a layout refers to; nulls are rasters that were not made."""
    return F.when(space == "geometry-corrected", F.coalesce(corrected, working, source)).otherwise(F.coalesce(working, source))


def transform_chain(source_w: Column, source_h: Column, working_w: Column, working_h: Column, correction: Column, crop_left: Column, crop_top: Column) -> Column:
    """The matrix from the source to a candidate: scaled, corrected (null: not), cropped."""
    zero, one = F.lit(0.0), F.lit(1.0)
    scale = geometry.matrix(working_w / source_w, zero, zero, zero, working_h / source_h, zero, zero, zero, one)
    shift = geometry.matrix(one, zero, -crop_left, zero, one, -crop_top, zero, zero, one)
    same = geometry.matrix(one, zero, zero, zero, one, zero, zero, zero, one)
    corrected = geometry.held(F.coalesce(correction, same), lambda m: geometry.compose(m, scale))
    return geometry.held(corrected, lambda m: geometry.compose(shift, m))


def source_band(centers: Column, row: Column, panel: Column, panels: Column, rhythm: Column, width: Column, height: Column) -> Column:
    """(left, top, right, bottom) of a segment's band in its raster; null where the row or the panel is absent."""
    n = F.size(centers)
    at = F.when(rhythm, n - 1).otherwise(row)
    top = F.when(at > 0, (F.get(centers, at - 1) + F.get(centers, at)) / 2).otherwise(0.0)
    bottom = F.when(at + 1 < n, (F.get(centers, at) + F.get(centers, at + 1)) / 2).otherwise(height.cast("double"))
    left, right = F.when(rhythm, 0.0).otherwise(panel * width / panels), F.when(rhythm, width.cast("double")).otherwise((panel + 1) * width / panels)
    return F.when((n > 0) & (row >= 0) & (at < n) & (panel >= 0) & (panel < panels), F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))
