"""Plane geometry on columns: 3 x 3 matrices as arrays of nine doubles (row by row), boxes and bilinear cells."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def matrix(*cells: Column) -> Column:
    return F.array(*(c.cast("double") for c in cells))


def held(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def compose(a: Column, b: Column) -> Column:
    """a after b."""
    return F.array(*(sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)))


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column, least: float = 1e-12) -> Column:
    """The inverse, null for a singular matrix."""
    det = determinant(m)
    minor = lambda a, b, c, d: m[a] * m[d] - m[b] * m[c]
    adjugate = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
    return F.when(F.abs(det) > least, F.array(*(x / det for x in adjugate)))


def project(m: Column, x: Column, y: Column, least: float = 1e-12) -> Column:
    """struct(x, y) of a point, null at infinity."""
    w = m[6] * x + m[7] * y + m[8]
    return F.when(F.abs(w) >= least, F.struct(((m[0] * x + m[1] * y + m[2]) / w).alias("x"), ((m[3] * x + m[4] * y + m[5]) / w).alias("y")))


def invertible(m: Column, least: float = 2.220446049250313e-16) -> Column:
    """Determinant of the matrix with rows of unit length is above machine precision."""
    norm = [F.sqrt(m[3 * i] * m[3 * i] + m[3 * i + 1] * m[3 * i + 1] + m[3 * i + 2] * m[3 * i + 2]) for i in range(3)]
    scale = norm[0] * norm[1] * norm[2]
    return F.coalesce((scale > 0) & (F.abs(determinant(m)) / scale > least), F.lit(False))


def valid_crop(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """The rounded box clipped to its raster; null if narrower than 320 or lower than 160."""
    r = lambda c: F.floor(c + 0.5)
    x0, y0 = F.greatest(F.lit(0), r(left)), F.greatest(F.lit(0), r(top))
    x1, y1 = F.least(width, r(right)), F.least(height, r(bottom))
    return F.when((x1 - x0 >= 320) & (y1 - y0 >= 160), F.struct(x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom")))


def bilinear(u: Column, v: Column, c00: Column, c10: Column, c01: Column, c11: Column) -> Column:
    return c00 * (1 - u) * (1 - v) + c10 * u * (1 - v) + c01 * (1 - u) * v + c11 * u * v


def barycentric(x: Column, y: Column, a: tuple, b: tuple, c: tuple, va: Column, vb: Column, vc: Column) -> Column:
    """Value at a point of the triangle whose corners are (x, y) pairs of columns."""
    det = (b[1] - c[1]) * (a[0] - c[0]) + (c[0] - b[0]) * (a[1] - c[1])
    la = ((b[1] - c[1]) * (x - c[0]) + (c[0] - b[0]) * (y - c[1])) / det
    lb = ((c[1] - a[1]) * (x - c[0]) + (a[0] - c[0]) * (y - c[1])) / det
    return la * va + lb * vb + (1 - la - lb) * vc


def axis_bounds(points: Column) -> Column:
    """Smallest box around an array of struct(x, y)."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("left"), F.array_min(ys).alias("top"), F.array_max(xs).alias("right"), F.array_max(ys).alias("bottom"))
