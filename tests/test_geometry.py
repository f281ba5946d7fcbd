"""Curves, label grids and source support against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import curves
from lacuna.operators import domains, labels, source_support
from lacuna.plans import policy

MARGINS = "margins array<struct<a:double,b:double,c:double>>"


def test_positive_intervals_by_fine_breakpoints(spark):
    rng = random.Random(3)
    cases = [[], [(0, 0, 1)], [(0, 0, -1)], [(0, 2, -1)], [(1, -1, 0.25)], [(-1, 1, -0.25)], [(0, 1, 0), (0, -1, 1)], [(4, -4, 0.75)]]
    cases += [[(rng.choice([0, rng.uniform(-9, 9)]), rng.uniform(-9, 9), rng.uniform(-3, 3)) for _ in range(rng.randint(1, 6))] for _ in range(120)]
    df = spark.createDataFrame([(k, [tuple(map(float, m)) for m in case]) for k, case in enumerate(cases)], f"k int, {MARGINS}")
    for r in df.select("k", curves.positive_intervals(F.col("margins")).alias("i")).collect():
        margins, found = cases[r["k"]], [(i["lo"], i["hi"]) for i in r["i"]]
        assert all(a < b for a, b in found) and found == sorted(found)
        for t in (np.arange(4000) + 0.5) / 4000:
            values = [(a * t + b) * t + c for a, b, c in margins]
            if all(abs(v) > 1e-3 for v in values):
                assert any(lo <= t <= hi for lo, hi in found) == all(v >= 0 for v in values), (margins, t)
    row = df.where("k in (4, 5)").select("k", curves.positive_intervals(F.col("margins")).alias("i")).orderBy("k").collect()
    assert [tuple(i) for i in row[0]["i"]] == [(0, 0.5), (0.5, 1)] and row[1]["i"] == []  # touching zero from above and from below


def test_bounds_and_cover(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, rng.uniform(-3, 3)]), rng.uniform(-3, 3), rng.uniform(-3, 3)) for _ in range(60)]
    lo, hi = curves.bounds(F.col("a"), F.col("b"), F.col("c"))
    for r in spark.createDataFrame(rows, "a double, b double, c double").select("a", "b", "c", lo.alias("lo"), hi.alias("hi")).collect():
        values = [(r["a"] * t + r["b"]) * t + r["c"] for t in np.linspace(0, 1, 2001)]
        assert r["lo"] == pytest.approx(min(values), abs=1e-5) and r["hi"] == pytest.approx(max(values), abs=1e-5)
    cases = [([(0.0, 1.0)], True), ([(0.5, 1.0), (0.0, 0.5)], True), ([(0.0, 0.4), (0.5, 1.0)], False), ([(0.0, 0.6), (0.2, 0.3), (0.6, 1.0)], True), ([], False), ([(0.1, 1.0)], False), ([(0.0, 0.99)], False)]
    df = spark.createDataFrame([(k, i) for k, (i, _) in enumerate(cases)], "k int, i array<struct<lo:double,hi:double>>")
    assert [r["c"] for r in df.orderBy("k").select(curves.covered(F.col("i")).alias("c")).collect()] == [ok for _, ok in cases]


def test_connections_meet_each_domain_once(spark):
    rng = random.Random(5)
    boxes = [(1, 10 * i + j, 7.0 * i, 5.0 * j, 7.0 * i + 7, 5.0 * j + 5) for i in range(6) for j in range(5) if (i, j) != (2, 2)]
    margins = lambda left, top, right, bottom: [(1.0, 0.0, -left), (-1.0, 0.0, right), (0.0, 1.0, -top), (0.0, -1.0, bottom)]
    mesh = spark.createDataFrame([(*b, margins(*b[2:])) for b in boxes], "page int, domain long, left double, top double, right double, bottom double, margins array<struct<ax:double,ay:double,k:double>>")
    paths = [(1, k, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.uniform(0, 42), rng.uniform(-10, 10), rng.uniform(0, 25)) for k in range(150)] + [(1, 900, None, 1.0, 1.0, 1.0, 1.0), (2, 901, 0.0, 1.0, 1.0, 1.0, 1.0), (1, 902, 0.0, 6.0, 0.5, 0.0, 2.0)]
    df = spark.createDataFrame(paths, "page int, id long, xa double, xb double, xc double, ydy double, y0 double")
    results = [{r["id"]: (r["covered"], [tuple(i) for i in r["intervals"]]) for r in domains.connections(df, mesh, ["page"], size).collect()} for size in (7.0, 2.0, 100.0)]
    assert results[0] == results[1] == results[2] and set(results[0]) == {p[1] for p in paths}
    assert results[0][900] == results[0][901] == (False, []) and results[0][902] == (True, [(0.0, 1.0, 0)])
    for _, k, *q in paths[:150]:
        at = lambda t: ((q[0] * t + q[1]) * t + q[2], q[3] * t + q[4])  # noqa: E731, B023
        for t in (np.arange(300) + 0.5) / 300:
            x, y = at(t)
            own = {b[1] for b in boxes if b[2] + 1e-6 < x < b[4] - 1e-6 and b[3] + 1e-6 < y < b[5] - 1e-6}
            assert own <= {d for lo, hi, d in results[0][k][1] if lo <= t <= hi}
            if not own and not any(b[2] - 1e-6 <= x <= b[4] + 1e-6 and b[3] - 1e-6 <= y <= b[5] + 1e-6 for b in boxes):
                assert not any(lo < t < hi for lo, hi, _ in results[0][k][1])


def test_label_fit_is_the_least_squares_fit(spark):
    rng = np.random.default_rng(2)
    names = {n: (r, k) for r, line in enumerate(policy.LABEL_ROWS) for k, n in enumerate(line)}
    pages, points = [], []
    for page in range(60):
        width, height, font = 1000, 700, 14.0
        some = list(rng.choice(list(names), rng.integers(0, 13), replace=False))
        if page % 5 == 0:
            some = [n for n in some if names[n][0] == 1]
        bent = 120.0 if page % 7 == 3 else 0.0
        for n in some + some[:2]:
            r, k = names[n]
            points.append((page, n, float(50 + 2 * r + 200 * k + rng.normal(0, 1.5)), float(80 + (150 + bent) * r + 3 * k + rng.normal(0, 1.5) + (40 if page % 9 == 4 and n == "V1" else 0))))
        points += [(page, "x9", 1.0, 1.0), (page, "I", None, 3.0)]
        pages.append((page, width, height, font))
    df = spark.createDataFrame(points, "page int, lead string, x double, y double")
    found = {r["page"]: r for r in labels.fit(df, spark.createDataFrame(pages, "page int, width int, height int, font double"), ["page"]).collect()}
    assert set(found) == set(range(60))
    seen = set()
    for page, w, h, font in pages:
        mine = [(names[n], x, y, n) for p, n, x, y in points if p == page and n in names and x is not None]
        design = np.array([[1, r, k, r * k] for (r, k), *_ in mine], float).reshape(-1, 4)
        rank, r = int(np.linalg.matrix_rank(design)) if len(mine) else 0, found[page]
        assert r["rank"] == rank
        if rank < 4:
            assert r["x_fit"] is None and not r["passed"] and r["failed"] is None
            continue
        target = np.array([[x, y] for _, x, y, _ in mine])
        beta = np.linalg.lstsq(design, target, rcond=None)[0]
        assert r["x_fit"] == pytest.approx(beta[:, 0].tolist(), abs=1e-6) and r["y_fit"] == pytest.approx(beta[:, 1].tolist(), abs=1e-6)
        x, y = beta.T
        off = np.abs(design @ beta - target)
        strays = sorted(n for ((a, k), _, _, n), e in zip(mine, off, strict=True) if not (e[0] < 0.04 * (x[2] + a * x[3]) and e[1] < max(0.6 * font, 0.04 * (y[1] + k * y[3]))))
        bad = [(a, k) for a in (0, 3) for k in (0, 3) if not 0.09 * h < y[1] + k * y[3] < 0.3 * h]
        assert r["strays"] == strays and sorted(f for f in r["failed"] if f.startswith("row_spacing")) == sorted(f"row_spacing:{a}:{k}" for a, k in bad)
        assert r["passed"] == (not strays and not r["failed"])
        seen.add((r["passed"], bool(strays), bool(bad)))
    assert {s[0] for s in seen} == {True, False} and any(s[1] for s in seen) and any(s[2] for s in seen)


def plain_support(shade, region, masked, unclear, points, tolerance):
    height, width = shade.shape
    evidence = (shade < 170) & region & ~masked & ~unclear
    spots = list(zip(*np.nonzero(evidence), strict=True))
    far = lambda x, y, them: min((math.hypot(x - b, y - a) for a, b in them), default=math.inf)
    rounded, inside, rows = [], [], []
    for x, y in points:
        ok = x is not None and y is not None
        px, py = (round(x), round(y)) if ok else (None, None)
        inside.append(ok and 0 <= px < width and 0 <= py < height)
        rounded.append((px, py))
        d = far(px, py, spots) if inside[-1] else math.inf
        clear = ok and not (inside[-1] and unclear[py, px])
        rows.append((d if d <= tolerance else None, clear, clear and (d > tolerance or not region[py, px] or masked[py, px]) if inside[-1] else clear))
    line = set()
    for k, (px, py) in enumerate(rounded):
        if inside[k]:
            sx, sy = rounded[k - 1] if k and inside[k - 1] else (px, py)
            n = max(abs(px - sx), abs(py - sy))
            line |= {(math.floor(sy + (py - sy) * t / max(n, 1) + 0.5), math.floor(sx + (px - sx) * t / max(n, 1) + 0.5)) for t in range(n + 1)}
    return rows, {(a, b) for a, b in spots if far(b, a, line) > tolerance}, spots


@pytest.mark.parametrize("tolerance", [1.0, 2.0, 3.7])
def test_source_support(spark, tolerance):
    rng = np.random.default_rng(int(tolerance * 10))
    height, width = 23, 31
    shade = np.where(rng.random((height, width)) < 0.15, 40, 220)
    region, masked, unclear = np.ones(shade.shape, bool), rng.random(shade.shape) < 0.1, rng.random(shade.shape) < 0.05
    region[:3] = False
    points = [(float(x), float(rng.uniform(-2, height + 1))) if x % 6 else (None, None) for x in range(-1, width + 2)]
    pixels = [(1, int(x), int(y), int(shade[y, x]), int(shade[y, x]), int(shade[y, x]), bool(region[y, x]), ["text"] if masked[y, x] else None, bool(unclear[y, x])) for y in range(height) for x in range(width)]
    df = spark.createDataFrame(pixels + pixels[:40], "page int, x long, y long, red int, green int, blue int, region boolean, excluded array<string>, ambiguous boolean")
    path = spark.createDataFrame([(1, k, *p) for k, p in enumerate(points)] + [(3, 0, 1.0, 1.0)], "page int, i int, x double, y double")
    pages = spark.createDataFrame([(1, width, height), (2, 5, 5), (3, 5, 5)], "page int, width int, height int")
    judged, left_out, summary = source_support.verify(df, path, pages, ["page"], tolerance, policy_masks := ["text", "grid", "calibration", "annotation"])
    rows, omitted, spots = plain_support(shade, region, masked, unclear, points, tolerance)
    got = {r["i"]: r for r in judged.where("page = 1").collect()}
    for k, (d, clear, bad) in enumerate(rows):
        assert (got[k]["distance"] is None) == (d is None) and got[k]["assessable"] == clear and got[k]["unsupported"] == bad, k
        assert d is None or got[k]["distance"] == pytest.approx(d)
    assert {(r["y"], r["x"]) for r in left_out.where("omitted").collect()} == omitted and left_out.count() == len(spots)
    said = {r["page"]: r for r in summary.collect()}
    assert said[1]["omitted"] == len(omitted) and said[1]["unsupported"] == sum(r[2] for r in rows) and said[1]["complete"] and len(policy_masks) == 4
    assert said[2]["reasons"] == [] and said[2]["omitted_fraction"] is None and said[3]["unsupported"] == 1
    plan = summary._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    # components by a flood over the same ink
    seen, sizes = set(), []
    for spot in sorted(spots):
        todo, size, lost = [spot], 0, 0
        while todo:
            a, b = todo.pop()
            if (a, b) in seen or (a, b) not in set(spots):
                continue
            seen.add((a, b))
            size, lost = size + 1, lost + ((a, b) in omitted)
            todo += [(a + i, b + j) for i, j in itertools.product((-1, 0, 1), repeat=2)]
        if size:
            sizes.append((size, lost))
    found = source_support.components(left_out, ["page"]).orderBy("component").collect()
    assert [(r["pixels"], r["omitted"]) for r in found] == sizes and [r["component"] for r in found] == list(range(len(sizes)))
    for bad in (0, -1, 21, float("nan")):
        with pytest.raises(ValueError):
            source_support.verify(df, path, pages, ["page"], bad)
