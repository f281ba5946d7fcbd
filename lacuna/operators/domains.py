"""Curves over a mesh of convex domains: which parts of each curve lie in which domain, and whether nothing is left out.

A curve runs over t in [0, 1] as x = (xa t + xb) t + xc, y = ydy t + y0. A domain is convex: its margins (ax, ay, k) hold
where ax x + ay y + k >= 0, and it has a box (left, top, right, bottom). Curve and domain meet by the cells of a grid that
both boxes touch, in the first cell they share; so no curve meets all domains, and each meeting happens once. Cells should be
about as large as a domain.

Rows: curves that no domain meets have no intervals and aren't covered; a null coefficient gives the same; repeated domains
give repeated intervals. A curve's id is unique within `by`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.functions import curves

c = F.col


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(F.floor(lo / size).cast("long"), F.floor(hi / size).cast("long"))


def _placed(df: DataFrame, mark: str, size: float) -> DataFrame:
    """Rows in each cell that their box (left, top, right, bottom with a mark) touches."""
    box = {s: c(f"{mark}_{s}") for s in ("left", "top", "right", "bottom")}
    wide = df.withColumn("cx", F.explode(_cells(box["left"], box["right"], size)))
    return wide.withColumn("cy", F.explode(_cells(box["top"], box["bottom"], size)))


def connections(paths: DataFrame, domains: DataFrame, by: list[str], size: float) -> DataFrame:
    """by, id, covered, intervals (lo, hi, domain), in order.

    paths: by, id, xa, xb, xc, ydy, y0; domains: by, domain, left, top, right, bottom, margins (array of ax, ay, k).
    """
    xlo, xhi = curves.bounds(c("xa"), c("xb"), c("xc"))
    end = c("y0") + c("ydy")
    known = paths.select(*by, "id", "xa", "xb", "xc", "ydy", "y0", xlo.alias("p_left"), xhi.alias("p_right"), F.least("y0", end).alias("p_top"), F.greatest("y0", end).alias("p_bottom"))
    whole = known.where("xa + xb + xc + ydy + y0 is not null")
    meshes = domains.select(*by, "domain", "margins", *(c(s).alias(f"d_{s}") for s in ("left", "top", "right", "bottom")))
    met = _placed(whole, "p", size).join(_placed(meshes, "d", size), [*by, "cx", "cy"])
    first = (c("cx") == F.floor(F.greatest("p_left", "d_left") / size)) & (c("cy") == F.floor(F.greatest("p_top", "d_top") / size))
    met = met.where(first & (c("p_right") >= c("d_left")) & (c("p_left") <= c("d_right")) & (c("p_bottom") >= c("d_top")) & (c("p_top") <= c("d_bottom")))
    along = F.transform("margins", lambda m: F.struct((m["ax"] * c("xa")).alias("a"), (m["ax"] * c("xb") + m["ay"] * c("ydy")).alias("b"), (m["ax"] * c("xc") + m["ay"] * c("y0") + m["k"]).alias("c")))
    pieces = met.select(*by, "id", "domain", F.explode(curves.positive_intervals(along)).alias("i")).select(*by, "id", F.struct("i.lo", "i.hi", "domain").alias("i"))
    found = pieces.groupBy(*by, "id").agg(F.array_sort(F.collect_list("i")).alias("intervals"))
    none = F.array().cast("array<struct<lo:double,hi:double,domain:long>>")
    listed = paths.select(*by, "id").join(found.hint("merge"), [*by, "id"], "left").withColumn("intervals", F.coalesce("intervals", none))
    return listed.select(*by, "id", curves.covered(c("intervals")).alias("covered"), "intervals")
