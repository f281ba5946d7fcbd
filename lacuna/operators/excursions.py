"""Narrow excursions that no other lead corroborates, judged by what the missing samples allow.

points: by, path, i, time, y, valid; events: by, path, event, time, extreme_time (within 0.08 s of it), pulse (height of a
calibration pulse), paired (another lead has an event there), peers (array of the paths that may corroborate). An event meets
the points of its time and its neighbours' by slots of a second's part, so a path is never one group.

The baseline on both sides is known only as far as the missing samples of the flanks allow: as the interval of their possible
medians. An excursion is rejected if it surely rises above it by enough, returns to it on both sides at once, is whole, and if
three peers have seen their part and none has an event. Events without a point in reach aren't rejected; a null counts as not
valid, not paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans import policy

from .ranges import fixed, middle

c = F.col
_P = policy.EXCURSION
_INF = float("inf")


def median_bounds(points: Column) -> Column:
    """count, known, lower, upper of the medians that points (y, valid) allow; a bound is null where they allow any."""
    possible = lambda fill: middle(F.transform(points, lambda p: F.when(p["valid"], p["y"]).otherwise(F.lit(fill))))
    finite = lambda x: F.when((x > -_INF) & (x < _INF), x)
    known = F.size(F.filter(points, lambda p: p["valid"]))
    return F.struct(F.size(points).alias("count"), known.alias("known"), F.when(F.size(points) > 0, finite(possible(-_INF))).alias("lower"), F.when(F.size(points) > 0, finite(possible(_INF))).alias("upper"))


def _slots(time: Column, width: float) -> Column:
    return F.floor(time / width).cast("long")


def _near(events: DataFrame, points: DataFrame, keys: list[str], width: float) -> DataFrame:
    """events with the points of their own slot and the two beside it."""
    spread = events.withColumn("_slot", F.explode(F.sequence(_slots(c("time"), width) - 1, _slots(c("time"), width) + 1)))
    held = points.select(*keys, _slots(c("time"), width).alias("_slot"), F.struct("i", c("time").alias("t"), "y", F.coalesce("valid", F.lit(False)).alias("valid")).alias("p"))
    return spread.join(held, [*keys, "_slot"], "left")


def peer_context(events: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """by, path, event, peer, columns, valid_fraction of each peer around an event; a peer without points has none."""
    wanted = events.select(*by, "path", "event", "time", F.explode("peers").alias("peer"))
    theirs = points.withColumnRenamed("path", "peer")
    met = _near(wanted, theirs, [*by, "peer"], 2 * _P["near"]).withColumn("in", F.abs(c("p.t") - c("time")) <= _P["near"])
    return met.groupBy(*by, "path", "event", "peer").agg(F.count_if("in").alias("columns"), F.coalesce(F.avg(F.when(c("in"), c("p.valid").cast("int"))), F.lit(0.0)).alias("valid_fraction"))


def classify(events: DataFrame, points: DataFrame, by: list[str]) -> DataFrame:
    """by, path, event, extreme, amplitude, width, failed (checks that aren't met), rejected, gap_start, gap_end."""
    seen = peer_context(events, points, by).groupBy(*by, "path", "event").agg(F.count("*").alias("n_peers"), F.min((c("columns") >= _P["peer_columns"]) & (c("valid_fraction") >= _P["peer_valid"])).alias("peers_seen"))
    near = _near(events, points, [*by, "path"], _P["flank"][1] + _P["near"])
    window = near.groupBy(*by, "path", "event").agg(*(F.first(n).alias(n) for n in ("time", "extreme_time", "pulse", "paired")), F.array_sort(F.collect_list(F.when(c("p").isNotNull() & c("p.t").isNotNull(), c("p")))).alias("w"))
    d = lambda p: p["t"] - c("time")
    top = F.array_min(F.transform("w", lambda p: F.struct(F.abs(p["t"] - c("extreme_time")).alias("off"), p["i"].alias("i"), p["t"].alias("t"), p["y"].alias("y"))))
    left = F.filter("w", lambda p: d(p).between(-_P["flank"][1], -_P["flank"][0]))
    right = F.filter("w", lambda p: d(p).between(_P["flank"][0], _P["flank"][1]))
    held = fixed(window, top=top, lb=median_bounds(left), rb=median_bounds(right))
    bounded = (c("lb.known") >= _P["known"]) & (c("rb.known") >= _P["known"]) & c("lb.lower").isNotNull() & c("lb.upper").isNotNull() & c("rb.lower").isNotNull() & c("rb.upper").isNotNull()
    held = fixed(held, bounded=F.coalesce(bounded, F.lit(False)))
    low, high = F.least("lb.lower", "rb.lower"), F.greatest("lb.upper", "rb.upper")
    held = fixed(held, low=F.when(c("bounded"), low), high=F.when(c("bounded"), high))
    held = fixed(held, amplitude=F.when(c("bounded"), F.greatest(c("low") - c("top.y"), c("top.y") - c("high"), F.lit(0.0))))
    held = fixed(held, band=F.greatest(F.lit(_P["band"]), c("amplitude") * _P["band_share"]) * F.when(c("bounded"), 1.0))
    back = F.filter("w", lambda p: p["valid"] & (F.abs(p["t"] - c("top.t")) <= _P["near"]) & (F.greatest(F.abs(p["y"] - c("low")), F.abs(p["y"] - c("high"))) <= c("band")))
    held = fixed(held, back=back)
    held = fixed(held, before=F.array_max(F.filter("back", lambda p: p["i"] < c("top.i"))), after=F.array_min(F.filter("back", lambda p: p["i"] > c("top.i"))))
    span = F.filter("w", lambda p: p["i"].between(c("before.i"), c("after.i")))
    core = F.filter("w", lambda p: F.abs(d(p)) <= _P["near"])
    returned = c("before").isNotNull() & c("after").isNotNull()
    held = fixed(held, width=F.when(returned, c("after.t") - c("before.t")), span=span, core=core).join(seen, [*by, "path", "event"], "left")
    checks = {
        "bounded": c("bounded"), "flanks_agree": c("high") - c("low") <= c("band"), "high_enough": c("amplitude") >= c("pulse") * _P["pulse"], "returns": returned, "narrow": c("width") <= _P["near"],
        "whole": returned & F.forall("span", lambda p: p["valid"]), "core_valid": (F.size("core") > 0) & F.forall("core", lambda p: p["valid"]), "peers_seen": (c("n_peers") == _P["peers"]) & c("peers_seen"), "alone": ~F.coalesce("paired", F.lit(False)),
    }
    failed = F.filter(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())), lambda f: f.isNotNull())
    judged = fixed(held, failed=failed)
    rejected = F.size("failed") == 0
    return judged.select(*by, "path", "event", c("top.i").alias("extreme"), "amplitude", "width", "failed", rejected.alias("rejected"), F.when(rejected, c("before.i")).alias("gap_start"), F.when(rejected, c("after.i") + 1).alias("gap_end"))
