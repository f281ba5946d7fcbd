"""Two-sided evidence of a traced path: points that no ink supports, and ink that no path follows.

Both directions are joins on the cells of a grid as wide as the tolerance: the path's side is put into the nine cells around
it, the ink keeps its own, and distances are taken within a cell. So no page meets itself in full, and a distance is known up to
the tolerance; beyond it is null. A path is drawn between points that follow each other, never over a missing one.

pixels: by.., x, y, red, green, blue, region, excluded (array of the kinds of masks that cover it, or null), ambiguous;
points: by.., i, x, y; pages: by.., width, height. A point with a null or infinite coordinate is missing. Repeated pixels count
once, by their strongest masks and darkest colour; repeated places of a path (by, i) are points of their own.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: What is dark, what tolerances are allowed, which masks make an attribution complete.
DARK, COLOURLESS, WIDEST = 170, 45, 20.0
MASKS = ["annotation", "calibration", "grid", "text"]


def dark(red: Column, green: Column, blue: Column) -> Column:
    """Near-grey and not light."""
    top = F.greatest(red, green, blue)
    return (top < DARK) & (top - F.least(red, green, blue) < COLOURLESS)


def ink(pixels: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y, region, excluded (boolean), ambiguous, evidence of each place."""
    held = pixels.select(*by, "x", "y", F.coalesce("region", F.lit(False)).alias("region"), (F.coalesce(F.size("excluded"), F.lit(0)) > 0).alias("excluded"), F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), F.coalesce(dark(c("red"), c("green"), c("blue")), F.lit(False)).alias("dark"))
    once = held.groupBy(*by, "x", "y").agg(*(F.max(n).alias(n) for n in ("region", "excluded", "ambiguous", "dark")))
    return once.withColumn("evidence", c("dark") & c("region") & ~c("excluded") & ~c("ambiguous")).drop("dark")


def placed(points: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """points with valid, px, py (rounded half to even) and inside."""
    finite = lambda n: c(n).isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf"))
    valid = finite("x") & finite("y")
    held = points.join(pages, by).withColumn("valid", valid).withColumns({"px": F.when(c("valid"), F.rint("x").cast("long")), "py": F.when(c("valid"), F.rint("y").cast("long"))})
    inside = c("valid") & (c("px") >= 0) & (c("px") < c("width")) & (c("py") >= 0) & (c("py") < c("height"))
    return held.withColumn("inside", F.coalesce(inside, F.lit(False))).select(*by, "i", "valid", "px", "py", "inside")


def drawn(path: DataFrame, by: list[str]) -> DataFrame:
    """by, x, y: the pixels of a path, its points joined where they follow each other."""
    before = Window.partitionBy(*by).orderBy("i", "px", "py")
    joined = path.select("*", *(F.when(F.lag("inside").over(before), F.lag(n).over(before)).alias(f"last_{n}") for n in ("px", "py"))).where("inside")
    start = {n: F.coalesce(f"last_{n}", n) for n in ("px", "py")}
    steps = F.greatest(F.abs(c("px") - start["px"]), F.abs(c("py") - start["py"]))
    each = joined.select(*by, "px", "py", start["px"].alias("sx"), start["py"].alias("sy"), steps.alias("n")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), c("n"))).alias("t"))
    along = lambda a, b: F.floor(c(a) + (c(b) - c(a)) * c("t") / F.greatest(c("n"), F.lit(1)) + F.lit(0.5))
    return each.select(*by, along("sx", "px").alias("x"), along("sy", "py").alias("y")).distinct()


def _cell(n: str, size: int) -> Column:
    return F.floor(c(n) / size)


def _around(df: DataFrame, x: str, y: str, size: int) -> DataFrame:
    """Rows in the nine cells around their place."""
    near = lambda n: F.sequence(_cell(n, size) - 1, _cell(n, size) + 1)
    return df.withColumn("cx", F.explode(near(x))).withColumn("cy", F.explode(near(y)))


def _runs(evidence: DataFrame, by: list[str]) -> DataFrame:
    """by, y, x0, x1, pixels, omitted of the stretches of ink in a line."""
    island = c("x") - F.row_number().over(Window.partitionBy(*by, "y").orderBy("x"))
    return evidence.withColumn("_island", island).groupBy(*by, "y", "_island").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("pixels"), F.count_if("omitted").alias("omitted")).drop("_island")


def _labelled(runs: pa.Table, by: list[str]) -> pa.Table:
    """by, component, pixels, omitted of whole pages, one behind the other, their runs (_n, from 1) in reading order."""
    held = {n: runs[n].to_numpy() for n in ("_n", "y", "x0", "x1", "pixels", "omitted")}
    first, y, x0, x1 = (held["_n"] == 1).tolist(), held["y"].tolist(), held["x0"].tolist(), held["x1"].tolist()
    own, above = list(range(len(y))), 0

    def root(k):
        while own[k] != k:
            own[k] = own[own[k]]
            k = own[k]
        return k

    for k in range(len(y)):
        if first[k]:
            above = k
        while above < k and (y[above] < y[k] - 1 or (y[above] == y[k] - 1 and x1[above] < x0[k] - 1)):
            above += 1
        j = above
        while j < k and y[j] == y[k] - 1 and x0[j] <= x1[k] + 1:
            a, b = sorted((root(j), root(k)))
            own[b] = a
            j += 1
    roots = np.fromiter((root(k) for k in range(len(y))), np.int64, len(y))
    heads = np.flatnonzero(roots == np.arange(len(y)))  # the first run of each piece; that of a page heads one
    piece = np.searchsorted(heads, roots)
    before = np.maximum.accumulate(np.where(held["_n"][heads] == 1, np.arange(len(heads)), 0))
    out = runs.select(by).take(pa.array(heads)).append_column("component", pa.array(np.arange(len(heads)) - before))
    for n in ("pixels", "omitted"):
        np.add.at(total := np.zeros(len(heads), np.int64), piece, held[n])
        out = out.append_column(n, pa.array(total))
    return out


def components(evidence: DataFrame, by: list[str]) -> DataFrame:
    """by, component (from 0 in reading order of their first pixels), pixels, omitted of pieces of ink that touch, corners included.

    The runs of ink of a page lie behind one another, those of many pages in a task; they are far fewer than its pixels. A task
    holds one page and one batch of Arrow.
    """

    def run(batches):
        held = []
        for batch in batches:
            starts = np.flatnonzero(batch["_n"].to_numpy() == 1)
            if len(starts):  # all pages but the last have ended
                cut = int(starts[-1])
                ended, held = [*held, batch.slice(0, cut)], [batch.slice(cut)]
                if sum(len(b) for b in ended):
                    yield from _labelled(pa.Table.from_batches(ended), by).combine_chunks().to_batches()
            else:
                held.append(batch)
        if held:
            yield from _labelled(pa.Table.from_batches(held), by).combine_chunks().to_batches()

    reading = Window.partitionBy(*by).orderBy(c("y").asc_nulls_last(), c("x0").asc_nulls_last())
    runs = _runs(evidence, by).withColumn("_n", F.row_number().over(reading))
    fields = ", ".join(f"`{n}` {runs.schema[n].dataType.simpleString()}" for n in by)
    return runs.mapInArrow(run, f"{fields}, component long, pixels long, omitted long")


def verify(pixels: DataFrame, points: DataFrame, pages: DataFrame, by: list[str], tolerance: float = 2.0, masks: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(points with distance, assessable and unsupported; evidence with omitted; a summary of each page).

    masks: the kinds of masks that were made, whether or not they cover anything. The summary has assessable, ambiguous,
    unsupported, unsupported_fraction, ink, omitted, omitted_fraction, reasons and complete.
    """
    if not (math.isfinite(tolerance) and 0 < tolerance <= WIDEST):
        raise ValueError("the tolerance must be above 0 and at most 20 pixels")
    size, most = max(1, math.ceil(tolerance)), F.lit(float(tolerance) ** 2)
    every, path = ink(pixels, by), placed(points, pages, by)
    evidence = every.where("evidence").select(*by, "x", "y", _cell("x", size).alias("cx"), _cell("y", size).alias("cy"))
    apart = (c("x") - c("px")) * (c("x") - c("px")) + (c("y") - c("py")) * (c("y") - c("py"))

    here = path.where("inside").select(*by, "i", "px", "py").distinct()
    near = _around(here, "px", "py", size).join(evidence, [*by, "cx", "cy"]).where(apart <= most).groupBy(*by, "i", "px", "py").agg(F.sqrt(F.min(apart)).alias("distance"))
    masked = every.select(*by, c("x").alias("px"), c("y").alias("py"), "region", "excluded", c("ambiguous").alias("unclear"))
    known = path.join(near, [*by, "i", "px", "py"], "left").join(masked, [*by, "px", "py"], "left")
    flag = lambda n: F.coalesce(n, F.lit(False)) & c("inside")
    known = known.withColumns({"in_region": flag("region"), "on_mask": flag("excluded"), "unclear": flag("unclear")}).withColumn("assessable", c("valid") & ~c("unclear"))
    judged = known.withColumn("unsupported", c("assessable") & (c("distance").isNull() | ~c("in_region") | c("on_mask"))).select(*by, "i", "valid", "distance", "in_region", "on_mask", "unclear", "assessable", "unsupported")

    line = drawn(path, by).select(*by, c("x").alias("px"), c("y").alias("py"))
    followed = _around(line, "px", "py", size).join(evidence, [*by, "cx", "cy"]).where(apart <= most).select(*by, "x", "y").distinct().withColumn("followed", F.lit(True))
    left_out = evidence.select(*by, "x", "y").join(followed, [*by, "x", "y"], "left").select(*by, "x", "y", c("followed").isNull().alias("omitted"))

    of_path = judged.groupBy(*by).agg(F.count_if("assessable").alias("assessable"), F.count_if(c("valid") & c("unclear")).alias("ambiguous"), F.count_if("unsupported").alias("unsupported"), F.count_if(c("valid") & ~c("in_region")).alias("outside"), F.count_if("on_mask").alias("on_mask"))
    of_ink = left_out.groupBy(*by).agg(F.count("*").alias("ink"), F.count_if("omitted").alias("omitted"))
    both = pages.select(*by).join(of_path, by, "left").join(of_ink, by, "left").fillna(0, ["assessable", "ambiguous", "unsupported", "outside", "on_mask", "ink", "omitted"])
    reasons = {"trace_without_visible_waveform_support": "unsupported", "visible_source_structure_omitted": "omitted", "trace_outside_lead_region": "outside", "trace_follows_excluded_nonwaveform_marks": "on_mask", "ambiguous_source_overlap": "ambiguous"}
    said = F.filter(F.array(*(F.when(c(n) > 0, F.lit(word)) for word, n in reasons.items())), lambda x: x.isNotNull())
    share = lambda n, of: F.when(c(of) > 0, c(n) / c(of))
    summary = both.select(*by, "assessable", "ambiguous", "unsupported", share("unsupported", "assessable").alias("unsupported_fraction"), "ink", "omitted", share("omitted", "ink").alias("omitted_fraction"), said.alias("reasons"), F.lit(set(MASKS) <= set(masks or [])).alias("complete"))
    return judged, left_out, summary
