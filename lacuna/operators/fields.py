"""Paper coordinates from a mesh of observed grid cells, both ways, and traced paths converted by them.

A cell (by, cell, x0, x1, u0, u1, v0, v1, mm0, mm1) lies between two columns; its upper edge runs from u0 to u1, its lower
edge from v0 to v1, and paper millimetres run from mm0 to mm1 between them along each column. Points meet cells in the squares
of a grid of `size` pixels (millimetres for the inverse), so no point meets a whole mesh. On an edge that cells share the cell
of the smallest number counts. Points outside of every cell, or with a null coordinate, have no place (null, n_cells 0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .domains import connections

c = F.col


def _edges(x: Column, cell: Callable[[str], Column]) -> tuple[Column, Column]:
    """Upper and lower edge of a cell at x."""
    t = (x - cell("x0")) / (cell("x1") - cell("x0"))
    return cell("u0") * (1 - t) + cell("u1") * t, cell("v0") * (1 - t) + cell("v1") * t


def forward(x: Column, y: Column, cell: Callable[[str], Column] = c) -> Column:
    """Millimetres of a point in a cell; null outside."""
    top, bottom = _edges(x, cell)
    inside = x.between(cell("x0"), cell("x1")) & y.between(top, bottom) & (bottom > top)
    return F.when(inside, cell("mm0") + (y - top) / (bottom - top) * (cell("mm1") - cell("mm0")))


def inverse(x: Column, mm: Column, cell: Callable[[str], Column] = c) -> Column:
    """The y at which a cell has so many millimetres; null outside."""
    top, bottom = _edges(x, cell)
    return F.when(x.between(cell("x0"), cell("x1")) & mm.between(cell("mm0"), cell("mm1")), top + (mm - cell("mm0")) / (cell("mm1") - cell("mm0")) * (bottom - top))


def _placed(points: DataFrame, cells: DataFrame, by: list[str], across: str, low: Column, high: Column, found: Callable[..., Column], size: float, out: str) -> DataFrame:
    """points with the first cell that each lies in, its value there, and how many cells it lies in.

    The cells of a square are one row, so a point stays one row as well: points are never grouped, nor joined with themselves.
    """
    square = lambda v: F.floor(v / size).cast("long")
    wide = cells.withColumn("_cx", F.explode(F.sequence(square(c("x0")), square(c("x1"))))).withColumn("_cy", F.explode(F.sequence(square(low), square(high))))
    squares = wide.groupBy(*by, "_cx", "_cy").agg(F.collect_list(F.struct("cell", "x0", "x1", "u0", "u1", "v0", "v1", "mm0", "mm1")).alias("_cells"))
    met = points.withColumns({"_cx": square(c("x")), "_cy": square(c(across))}).join(squares, [*by, "_cx", "_cy"], "left")
    each = F.transform("_cells", lambda m: F.struct(m["cell"].alias("cell"), found(c("x"), c(across), lambda n: m[n]).alias("found")))
    held = met.withColumn("_in", F.explode(F.array(F.filter(each, lambda m: m["found"].isNotNull()))))  # once a row, not in each use
    best = F.array_min("_in")
    return held.withColumns({"cell": best["cell"], out: best["found"], "n_cells": F.coalesce(F.size("_in"), F.lit(0)).cast("long")}).withColumn("n_cells", F.greatest("n_cells", F.lit(0).cast("long"))).drop("_in", "_cells", "_cx", "_cy")


def to_paper(points: DataFrame, cells: DataFrame, by: list[str], size: float) -> DataFrame:
    """points (by, i, x, y and others) with cell, mm and n_cells."""
    return _placed(points, cells, by, "y", F.least("u0", "u1"), F.greatest("v0", "v1"), forward, size, "mm")


def to_source(points: DataFrame, cells: DataFrame, by: list[str], size: float) -> DataFrame:
    """points (by, i, x, mm and others) with cell, y and n_cells; size in millimetres and columns alike."""
    return _placed(points, cells, by, "mm", c("mm0"), c("mm1"), inverse, size, "y")


def mesh(cells: DataFrame, by: list[str]) -> DataFrame:
    """The cells as domains of curves."""
    us, vs = ((c(b) - c(a)) / (c("x1") - c("x0")) for a, b in (("u0", "u1"), ("v0", "v1")))
    margin = lambda ax, ay, k: F.struct(ax.alias("ax"), ay.alias("ay"), k.alias("k"))
    one, none = F.lit(1.0), F.lit(0.0)
    margins = F.array(margin(one, none, -c("x0")), margin(-one, none, c("x1")), margin(-us, one, us * c("x0") - c("u0")), margin(vs, -one, c("v0") - vs * c("x0")))
    return cells.select(*by, c("cell").alias("domain"), c("x0").alias("left"), F.least("u0", "u1").alias("top"), c("x1").alias("right"), F.greatest("v0", "v1").alias("bottom"), margins.alias("margins"))


def converted(points: DataFrame, cells: DataFrame, by: list[str], size: float, gain: float = 10.0, rate: int = 500) -> tuple[DataFrame, DataFrame]:
    """(points with mm, mv and joined; by, path, target, mv at multiples of 1 / rate).

    points: by, path, i (columns in order), x, y, time (rising), valid. A point counts if it is valid and lies in a cell; two
    that follow each other are joined if the whole way between them lies in cells. Millivolts are millimetres above the path's
    median by `gain`. Samples are interpolated between joined points alone, so gaps stay gaps, and so do single points.
    """
    own = Window.partitionBy(*by, "path").orderBy("_i")
    held = points.withColumnRenamed("i", "_i").withColumn("i", F.struct("path", c("_i").alias("i")))
    usable = F.when(F.coalesce("valid", F.lit(False)), c("y"))
    mapped = to_paper(held.withColumn("_y", c("y")).withColumn("y", usable), cells, by, size).withColumn("y", c("_y")).drop("_y")
    after = mapped.withColumns({n: F.lead(v).over(own) for n, v in (("_y2", "y"), ("_x2", "x"), ("_mm2", "mm"), ("_t2", "time"), ("_n2", "_i"))})
    candidate = c("mm").isNotNull() & c("_mm2").isNotNull() & (c("_n2") == c("_i") + 1)
    ways = after.where(candidate).select(*by, c("i").alias("id"), F.lit(0.0).alias("xa"), (c("_x2") - c("x")).alias("xb"), c("x").alias("xc"), (c("_y2") - c("y")).alias("ydy"), c("y").alias("y0"))
    whole = connections(ways, mesh(cells, by), by, size).where("covered").select(*by, c("id").alias("i"), F.lit(True).alias("joined"))
    # by merges: ways and paths are as many as the points, which an estimate from behind generators doesn't know
    linked = after.join(whole.hint("merge"), [*by, "i"], "left").withColumn("joined", F.coalesce("joined", F.lit(False)))
    middle = linked.groupBy(*by, "path").agg(F.percentile("mm", F.lit(0.5)).alias("_middle"))
    volts = linked.join(middle.hint("merge"), [*by, "path"]).withColumn("mv", (c("_middle") - c("mm")) / gain)
    ends = volts.withColumns({"_mv2": F.lead("mv").over(own), "_next": F.coalesce(F.lead("joined").over(own), F.lit(False))})
    steps = ends.where("joined").withColumn("target", F.explode(F.filter(F.sequence(F.ceil(c("time") * rate), F.greatest(F.ceil(c("time") * rate), F.floor(c("_t2") * rate))), lambda k: (k / rate >= c("time")) & (k / rate <= c("_t2")) & ((k / rate < c("_t2")) | ~c("_next")))))
    part = (c("target") / rate - c("time")) / (c("_t2") - c("time"))
    samples = steps.select(*by, "path", "target", (c("mv") + (c("_mv2") - c("mv")) * part).alias("mv"))
    return volts.select(*by, "path", c("_i").alias("i"), "x", "y", "cell", "n_cells", "mm", "mv", "joined"), samples
