"""Quadratics over [0, 1] as array expressions: roots, extent, and where several of them are non-negative."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How far intervals may lie apart and still cover.
SLACK = 1e-12


def roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots of a t**2 + b t + c, each once, without cancellation; none for a constant."""
    d = b * b - 4 * a * c
    q = -0.5 * (b + F.when(b < 0, -F.sqrt(d)).otherwise(F.sqrt(d)))
    none = F.array().cast("array<double>")
    return F.when(a == 0, F.when(b == 0, none).otherwise(F.array(-c / b))).when(d < 0, none).when(d == 0, F.array(-b / (2 * a))).otherwise(F.array(q / a, c / q))


def value(a: Column, b: Column, c: Column, t: Column) -> Column:
    return (a * t + b) * t + c


def bounds(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Least and largest value on [0, 1]."""
    turn = F.when(a != 0, -b / (2 * a))
    inner = F.when((turn > 0) & (turn < 1), value(a, b, c, turn))
    return F.least(c, a + b + c, inner), F.greatest(c, a + b + c, inner)


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), its value worked out once, not again for each place and each element at which a lambda names it."""
    return F.transform(F.array(value), use)[0]


def positive_intervals(margins: Column) -> Column:
    """Intervals (lo, hi) of [0, 1], cut at all roots, in which every margin (a, b, c) is non-negative.

    Whether an interval counts is decided in its middle, so margins that only touch zero don't end one. No margins: all of it.
    """

    def cuts(of: Column) -> Column:
        inner = F.filter(F.flatten(F.transform(of, lambda m: roots(m["a"], m["b"], m["c"]))), lambda t: (t > 0) & (t < 1))
        return F.sort_array(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), inner)))

    def pieces(at: Column) -> Column:
        return F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at)), lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi")))

    holds = lambda of, p: F.forall(of, lambda m: value(m["a"], m["b"], m["c"], (p["lo"] + p["hi"]) / 2) >= 0)
    return _once(margins, lambda of: F.filter(_once(cuts(of), pieces), lambda p: holds(of, p)))


def covered(intervals: Column) -> Column:
    """Whether intervals (lo, hi) leave no gap in [0, 1]."""
    reach = F.aggregate(F.array_sort(intervals), F.lit(0.0), lambda end, p: F.when(p["lo"] > end + SLACK, end).otherwise(F.greatest(end, p["hi"])))
    return reach >= 1 - SLACK
