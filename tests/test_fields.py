"""Paper coordinates and narrow excursions against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.operators import excursions, fields

CELLS = "page int, cell long, x0 double, x1 double, u0 double, u1 double, v0 double, v1 double, mm0 double, mm1 double"


def cells_of(seed=1):
    rng = random.Random(seed)
    top = [rng.uniform(0, 3) for _ in range(9)]
    mid = [rng.uniform(10, 13) for _ in range(9)]
    low = [rng.uniform(22, 25) for _ in range(9)]
    rows = []
    for k in range(8):
        for r, (a, b) in enumerate(((top, mid), (mid, low))):
            if (k, r) != (3, 0):
                rows.append((1, 2 * k + r, 6.0 * k, 6.0 * k + 6, a[k], a[k + 1], b[k], b[k + 1], 5.0 * r, 5.0 * r + 5))
    return rows


def plain_mm(rows, x, y):
    for _, cell, x0, x1, u0, u1, v0, v1, m0, m1 in sorted(rows, key=lambda r: r[1]):
        t = (x - x0) / (x1 - x0)
        top, bottom = u0 * (1 - t) + u1 * t, v0 * (1 - t) + v1 * t
        if x0 <= x <= x1 and top <= y <= bottom:
            return cell, m0 + (y - top) / (bottom - top) * (m1 - m0)
    return None, None


def test_there_and_back(spark):
    rng, rows = random.Random(2), cells_of()
    cells = spark.createDataFrame(rows, CELLS)
    places = [(1, k, rng.uniform(-2, 50), rng.uniform(-2, 28)) for k in range(300)] + [(1, 400 + k, 6.0 * k, rows[0][4] if k == 0 else 12.0) for k in range(9)] + [(1, 500, None, 3.0), (1, 501, 3.0, None), (2, 502, 3.0, 5.0), (1, 503, 48.0, 24.0)]
    points = spark.createDataFrame(places, "page int, i int, x double, y double")
    for size in (6.0, 1.5, 80.0):
        got = {r["i"]: r for r in fields.to_paper(points, cells, ["page"], size).collect()}
        assert len(got) == len(places)
        for page, i, x, y in places:
            cell, mm = plain_mm(rows, x, y) if page == 1 and x is not None and y is not None else (None, None)
            assert got[i]["cell"] == cell and (got[i]["mm"] is None if mm is None else got[i]["mm"] == pytest.approx(mm)), (i, size)
            assert (got[i]["n_cells"] > 0) == (cell is not None)
    assert got[400 + 2]["n_cells"] >= 2  # on an edge of two cells
    there = fields.to_paper(points, cells, ["page"], 6.0).where("mm is not null").select("page", "i", "x", "mm", F.col("y").alias("was"))
    back = fields.to_source(there, cells, ["page"], 5.0).collect()
    assert len(back) > 150 and all(r["y"] == pytest.approx(r["was"]) for r in back)
    assert fields.to_source(spark.createDataFrame([(1, 0, 3.0, 99.0), (1, 1, -5.0, 2.0)], "page int, i int, x double, mm double"), cells, ["page"], 5.0).where("y is not null").count() == 0


def test_conversion_keeps_gaps(spark):
    """One missing column, one hole in the mesh, one point alone; samples lie between joined points only."""
    rows = [(1, k, 10.0 * k, 10.0 * k + 10, 0.0, 0.0, 20.0, 20.0, 0.0, 5.0) for k in range(4) if k != 2]
    ys = [10 + 4 * np.sin(i / 3) for i in range(40)]
    valid = [i not in (5, 8, 10) for i in range(40)]
    points = spark.createDataFrame([(1, 7, i, float(i), float(ys[i]), i / 100, valid[i]) for i in range(40)], "page int, path int, i int, x double, y double, time double, valid boolean")
    mapped, samples = fields.converted(points, spark.createDataFrame(rows, CELLS), ["page"], 10.0, 10.0, 250)
    got = {r["target"]: r["mv"] for r in samples.collect()}
    mm = {i: ys[i] / 4 for i in range(40) if valid[i] and not 20 < i < 30}
    middle = float(np.median(list(mm.values())))
    runs = [[0, 1, 2, 3, 4], [6, 7], [*range(11, 21)], [*range(30, 40)]]
    want = {}
    for run in runs:
        for k in range(101):
            t = k / 250
            if run[0] / 100 <= t <= run[-1] / 100:
                want[k] = float(np.interp(t, [i / 100 for i in run], [(middle - mm[i]) / 10 for i in run]))
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want) and samples.count() == len(want)
    assert mapped.where("joined").count() == sum(len(r) - 1 for r in runs) and mapped.count() == 40


def plain_bounds(y, valid):
    if not len(y):
        return None, None, 0
    with np.errstate(invalid="ignore"):
        lo, hi = np.median(np.where(valid, y, -np.inf)), np.median(np.where(valid, y, np.inf))
    return (lo if np.isfinite(lo) else None), (hi if np.isfinite(hi) else None), int(valid.sum())


def plain_failed(y, t, valid, time, extreme, pulse, paired, peers):
    i = int(np.argmin(abs(t - extreme)))
    d = t - time
    sides = [plain_bounds(y[s], valid[s]) for s in ((d <= -0.08) & (d >= -0.12), (d >= 0.08) & (d <= 0.12))]
    bounded = all(lo is not None and hi is not None and n >= 2 for lo, hi, n in sides)
    failed = set() if bounded else {"bounded"}
    li = ri = amplitude = None
    if bounded:
        low, high = min(s[0] for s in sides), max(s[1] for s in sides)
        amplitude = max(low - y[i], y[i] - high, 0.0)
        band = max(2.0, 0.1 * amplitude)
        near = valid & (np.maximum(abs(y - low), abs(y - high)) <= band) & (abs(t - t[i]) <= 0.04)
        before, after = [k for k in np.flatnonzero(near) if k < i], [k for k in np.flatnonzero(near) if k > i]
        li, ri = (before[-1] if before else None), (after[0] if after else None)
    returned = li is not None and ri is not None
    core = abs(d) <= 0.04
    checks = {"flanks_agree": bounded and high - low <= band, "high_enough": bounded and amplitude >= 0.3 * pulse, "returns": returned, "narrow": returned and t[ri] - t[li] <= 0.04, "whole": returned and valid[li : ri + 1].all(), "core_valid": core.any() and valid[core].all(), "peers_seen": len(peers) == 3 and all(n >= 2 and share >= 0.9 for n, share in peers), "alone": not paired}
    return failed | {k for k, ok in checks.items() if not ok}, i, amplitude, (li, ri)


def test_excursions(spark):
    rng = np.random.default_rng(5)
    points, events, series = [], [], {}
    for page in range(12):
        for path in range(4):
            n = 90
            t, y = np.arange(n) / 125 + path / 1000, rng.normal(0, 0.4, n)
            spike = 30 + 3 * path + page % 5
            if (page + path) % 3:
                y[spike] += rng.choice([14.0, 30.0, -25.0])
            valid = rng.random(n) > (0.0, 0.04, 0.3)[page % 3]
            series[page, path] = (t, y, valid, spike)
            points += [(page, path, i, float(t[i]), float(y[i]), bool(valid[i])) for i in range(n) if page != 11 or path]
            events.append((page, path, 1, float(t[spike]) + 0.0021, float(t[spike]) + 0.0004, 40.0, bool((page + path) % 5 == 0), [p for p in range(4) if p != path]))
    pdf = spark.createDataFrame(points, "page int, path int, i int, time double, y double, valid boolean").repartition(5)
    edf = spark.createDataFrame(events, "page int, path int, event int, time double, extreme_time double, pulse double, paired boolean, peers array<int>")
    got = {(r["page"], r["path"]): r for r in excursions.classify(edf, pdf, ["page"]).collect()}
    assert set(got) == set(series)
    rejected = 0
    for (page, path), (t, y, valid, _) in series.items():
        r = got[page, path]
        _, _, _, time, extreme, pulse, paired, peers = next(e for e in events if e[:2] == (page, path))
        if page == 11 and path == 0:  # no points of its own
            assert not r["rejected"] and r["extreme"] is None and "bounded" in r["failed"]
            continue
        seen = []
        for p in peers:
            pt, _, pv, _ = series[page, p]
            at = abs(pt - time) <= 0.04
            seen.append((int(at.sum()), float(pv[at].mean())) if page != 11 or p else (0, 0.0))
        failed, i, amplitude, (li, ri) = plain_failed(y, t, valid, time, extreme, pulse, paired, seen)
        assert set(r["failed"]) == failed and r["extreme"] == i, (page, path)
        assert r["amplitude"] == (None if amplitude is None else pytest.approx(amplitude)) and r["rejected"] == (not failed)
        if not failed:
            rejected += 1
            assert (r["gap_start"], r["gap_end"]) == (li, ri + 1)
    assert rejected >= 3
