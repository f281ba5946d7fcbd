"""Violations, alignment, crossing paths and time ranges against plain searches."""

import itertools
import random
from collections import deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import contracts, kernels
from lacuna.operators import alignment, evidence, grouped, ranges
from lacuna.plans import policy


def test_violations_agree_in_every_action(spark, tmp_path):
    """Rules over fields of structs, of which Spark prunes what an explode doesn't name."""
    k = F.col("id")
    matrix = F.array(*(F.lit(float(x)) for x in (1, 0, 2, 0, 1, 3, 0, 0, 1)))
    reports = spark.range(60).select(
        "id", F.when(k % 3 == 0, 7).otherwise(6).alias("version"), F.lit("0a1b2c3d4e5f6789" * 4).alias("sha"), F.struct(F.lit(1000).alias("width"), F.lit(600).alias("height")).alias("source"),
        F.struct(F.lit(500).alias("width"), F.lit(300).alias("height"), F.lit(0.5).alias("scale_x"), F.lit(0.5).alias("scale_y"), F.lit("m").alias("method"), F.lit(4000).alias("most")).alias("working"),
        F.struct(F.when(k % 2 == 0, "insufficient").otherwise("review").alias("outcome"), F.lit(True).alias("eligible"), F.when(k % 5 == 0, 999).otherwise(1000).alias("long_edge"), F.lit(600).alias("short_edge"), F.lit(0.5).alias("scale"), F.array(F.lit("r")).alias("reasons")).alias("quality"),
        F.when(k % 2 == 0, F.struct(F.lit(True).alias("applied"), F.lit("m").alias("method"), F.lit(0.9).alias("confidence"), F.lit(10).alias("width"), F.lit(10).alias("height"), matrix.alias("transform"), (k % 14 == 0).alias("reconstructed"))).alias("correction"),
    )
    rules = contracts.preparation_rules()
    reports.write.parquet(f"{tmp_path}/reports")
    reports = spark.read.parquet(f"{tmp_path}/reports")
    found = evidence.violations(reports, ["id"], rules)
    rows = sorted(map(tuple, found.collect()))
    assert len(rows) == found.count() > 0
    found.write.parquet(f"{tmp_path}/found")
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/found").collect())) == rows
    for name, ok in rules.items():
        alone = evidence.violations(reports, ["id"], {name: ok})
        want = reports.where(~F.coalesce(ok, F.lit(False))).count()
        assert alone.count() == len(alone.collect()) == want == sum(r[1] == name for r in rows)


@pytest.mark.parametrize("n, m", [(64, 64), (30, 27), (5, 5), (900, 900)])
def test_alignment_of_many_is_the_plain_search(n, m):
    rng = np.random.default_rng(n)
    a, b = rng.normal(size=(9, n)), rng.normal(size=(9, m))
    a[0, : n // 2], b[1, :], a[2, 3], b[3, 1 : m : 3] = np.nan, np.nan, np.nan, np.nan
    if n == m:
        b[4], b[5] = np.roll(a[4], 3), a[5] + 7
    scale, shift, offset, error = kernels.align_many(a, b, cells=n * 205 * 2)
    for k in range(9):
        if n == m:
            want = kernels.align(a[k], b[k])
            if want is None:
                assert np.isinf(error[k])
            else:
                assert (scale[k], shift[k]) == want[:2] and offset[k] == pytest.approx(want[2]) and error[k] == pytest.approx(want[3], abs=1e-12)
    assert np.isinf(error[1])


def test_pair_table(spark):
    """Pairs meet within a run and lead alone; short, empty and missing leads have no match."""
    rng = random.Random(3)
    wave = [rng.gauss(0, 100) for _ in range(80)]
    rows = [(1, "I", 1, wave[:60]), (1, "I", 2, wave[5:65]), (1, "I", 3, [None] * 60), (1, "II", 1, wave[:60]), (2, "I", 4, wave[:60]), (1, "I", 5, []), (1, "I", 6, None), (1, "II", 7, [x + 9 for x in wave[:60]])]
    leads = spark.createDataFrame(rows, "run int, lead string, id int, values array<double>")
    pairs = alignment.pair_table(leads, ["run", "lead"], "id")
    got = {(r["run"], r["lead"], r["a"], r["b"]): r for r in pairs.collect()}
    assert set(got) == {(1, "I", a, b) for a, b in itertools.combinations((1, 2, 3, 5), 2)} | {(1, "II", 1, 7)}
    assert (got[1, "I", 1, 2]["scale"], got[1, "I", 1, 2]["shift"]) == (1.0, -5) and got[1, "I", 1, 2]["rmse"] < 1e-9
    assert got[1, "II", 1, 7]["offset"] == pytest.approx(9) and all(r["rmse"] is None and r["shift"] is None for k, r in got.items() if 3 in k[2:] or 5 in k[2:])
    spoken = {(r["run"], r["candidate"]): (r["penalty"], r["compared"]) for r in alignment.penalties(pairs.drop("lead"), ["run"]).collect()}
    assert spoken[1, 3] == (0, 0) and spoken[1, 1] == (0, 2)
    assert alignment.pair_table(leads.limit(0), ["run", "lead"], "id").count() == 0


def test_dense_arrays(spark):
    rows = [(1, "a", 3, 1.0), (1, "a", 6, 2.0), (1, "a", 6, 5.0), (1, "b", 4, None), (1, "b", 8, 7.0), (2, "a", -1, 0.5), (3, "a", 1, None)]
    got = {(r["run"], r["id"]): (r["lo"], r["values"]) for r in alignment.dense(spark.createDataFrame(rows, "run int, id string, sample long, value double"), ["run"], "id").collect()}
    assert got == {(1, "a"): (3, [1.0, None, None, 2.0, None, None]), (1, "b"): (3, [None] * 5 + [7.0]), (2, "a"): (-1, [0.5])}


def test_aligned_values_and_spreads(spark):
    rng = random.Random(4)
    wave = [rng.gauss(0, 50) for _ in range(50)]
    a, b = wave[:40], [x + 3 for x in wave[4:44]]
    a[7] = None
    leads = spark.createDataFrame([(1, 1, a), (1, 2, b)], "run int, id int, values array<double>")
    pairs = alignment.pair_table(leads, ["run"], "id")
    got = {r["place"]: r["value"] for r in alignment.aligned_values(leads, pairs, ["run"], "id").collect()}
    assert all(got[i] is None for i in range(4)) and all(got[i] == pytest.approx(wave[i]) for i in range(4, 40))
    spread = {r["place"]: r for r in alignment.spreads(leads, pairs, ["run"], "id").collect()}
    assert spread[7]["status"] == "missing" and spread[7]["candidates"] == 1 and spread[2]["candidates"] == 1 and spread[20]["candidates"] == 2 and spread[20]["spread"] == pytest.approx(0, abs=1e-9)


def plain_states(column, home):
    """Rows as the rule names them, by walking the column."""
    found, run = {min(max(home, 0), len(column) - 1), int(np.argmax(column))}, []
    for r, e in enumerate([*column, -1.0]):
        if e >= 0.28:
            run.append(r)
        elif run:
            found |= {run[0], run[-1], max(run, key=lambda q: (column[q], -q))} | ({run[len(run) // 3], run[len(run) * 2 // 3]} if len(run) >= 6 else set())
            run = []
    return sorted(found)


def plain_flood(ink, seeds):
    todo, seen = deque(zip(*np.nonzero(ink & seeds), strict=True)), set()
    while todo:
        y, x = todo.popleft()
        if (y, x) in seen or not (0 <= y < ink.shape[0] and 0 <= x < ink.shape[1]) or not ink[y, x]:
            continue
        seen.add((y, x))
        todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    out = np.zeros(ink.shape, bool)
    for y, x in seen:
        out[y, x] = True
    return out


@pytest.mark.parametrize("seed", range(25))
def test_crossing_path_is_the_cheapest_of_all(seed):
    rng = np.random.default_rng(seed)
    height, width, start, center, spacing = 7, 5, 20, 22.5, 4.0
    e = np.where(rng.random((height, width)) < 0.5, rng.random((height, width)), 0.0)
    reward, scale, excursion, radius, anchors = (0.0, 0.2)[seed % 2], 1.0 + seed % 3, (0.0, 3.0)[seed % 4 > 1], 2, np.array([1, 4])
    reference = np.clip(rng.integers(start - 1, start + height + 1, width), start - 1, start + height)
    support = None
    if seed % 5:
        support = np.zeros(e.shape, bool)
        for anchor in anchors:
            left, right = max(0, anchor - radius), min(width, anchor + radius + 1)
            if right - left >= 3:
                seeds = np.zeros((height, right - left), bool)
                for x in (left, left + 1, right - 2, right - 1):
                    if 0 <= reference[x] - start < height:
                        seeds[reference[x] - start, x - left] = True
                support[:, left:right] |= plain_flood(e[:, left:right] >= 0.24, seeds)
        assert (kernels.event_support(e, start, reference, anchors, radius) == support).all()
    got = kernels.crossing_path(e, start, center, spacing, scale, reward, anchors, radius, excursion, support)
    home = round(center) - start
    states = [plain_states(e[:, x].tolist(), home) for x in range(width)]
    assert [kernels.candidate_rows(e[:, x], home).tolist() for x in range(width)] == states

    def cost(path):
        total = 0.0
        for x, r in enumerate(path):
            away, gap = abs(r + start - center) / spacing, min(abs(a - x) for a in anchors)
            total += 5 * (1 - e[r, x]) + 4 * away**2
            if gap <= radius:
                total -= excursion * (1 - gap / (radius + 1)) * away * (support[r, x] if support is not None else 1)
            if x:
                step = abs(r - path[x - 1])
                crossed = e[min(r, path[x - 1]) : max(r, path[x - 1]) + 1, x]
                total += scale * (0.0025 * step + 0.000018 * step**2) - (reward * step if (crossed < 0.24).sum() <= max(2, int(len(crossed) * 0.08)) else 0)
        return total

    assert cost([r - start for r in got]) == pytest.approx(min(map(cost, itertools.product(*states))))


def test_states_are_bounded():
    rng = np.random.default_rng(1)
    column = np.where(np.arange(400) % 3 == 0, 0.3 + rng.random(400) / 2, 0.0)
    rows = kernels.candidate_rows(column, 200)
    assert len(rows) <= policy.CROSSING["states"] and {0, 399, int(column.argmax())} <= set(rows.tolist()) and abs(rows - 200).min() <= 1


def test_crossing_groups(spark):
    ink = lambda *at: [1.0 if r in at else 0.0 for r in range(9)]
    rows = [(1, x, 100, 104.0, 5.0, ink(4), x == 2, 104) for x in range(5)] + [(2, x, 0, 4.0, 5.0, ink(x), None, None) for x in range(9)] + [(3, x, 0, 4.0, 5.0, ink(4), False, None) for x in range(2)]
    panels = spark.createDataFrame(rows, "panel long, x int, y_start int, row_center double, row_spacing double, evidence array<double>, anchor boolean, reference int")
    got = {(r["panel"], r["x"]): r["y"] for r in grouped.crossings(panels, reward=0.1, radius=1, excursion=1.0).collect()}
    assert got == {(1, x): 104 for x in range(5)} | {(2, x): x for x in range(9)}
    for bad in ({"scale": 0}, {"reward": -1}, {"radius": -1}, {"excursion": float("-inf")}):
        with pytest.raises(ValueError):
            kernels.crossing_path(np.zeros((4, 4)), 0, 2, 2, **bad)


def pages_of(spark, n_rows, columns, step=20, width=140):
    """One page for each entry of columns: the columns that hold ink in all rows."""
    pages = spark.createDataFrame([(k, width, step * (n_rows + 1)) for k in range(len(columns))], "k int, width int, height int")
    rows = spark.createDataFrame([(k, r, step * (r + 1)) for k in range(len(columns)) for r in range(n_rows)], "k int, row int, center int")
    pixels = spark.createDataFrame([(k, step * (r + 1), x, 0.9) for k, inked in enumerate(columns) for r in range(n_rows) for x in inked], "k int, y int, x int, ink double")
    return pages, rows, pixels


def test_panels_of_two(spark):
    cases = [[*range(8, 58), *range(80, 131)], [*range(6, 110)], [*range(10, 105)], [x for x in range(140) if x % 13 == 0], [x for x in [*range(3, 68), *range(74, 124)] if x % 3], [*range(8, 58)], []]
    pages, rows, pixels = pages_of(spark, 6, cases)
    pages = pages.selectExpr("*", "0.4D AS pixels_per_mm", "25D AS speed")
    got = {r["k"]: (r["method"], tuple(r["left"]), tuple(r["right"])) for r in ranges.six_by_two(pixels.union(pixels), rows, pages, ["k"]).collect()}
    assert got == {0: ("runs", (8, 58), (81, 131)), 1: ("double_run", (6, 56), (60, 110)), 2: ("split_run", (10, 58), (58, 105)), 4: ("window_to_gutter", (18, 68), (73, 123))}
    none = lambda **change: ranges.six_by_two(pixels, rows, pages.withColumns(change), ["k"]).count()
    assert none(speed=F.lit(None).cast("double")) == none(pixels_per_mm=F.lit(0.2)) == none(pixels_per_mm=F.lit(0.9)) == none(height=F.lit(100)) == 0
    assert ranges.six_by_two(pixels, rows.where("row < 5"), pages, ["k"]).count() == 0 and ranges.six_by_two(pixels.limit(0), rows, pages, ["k"]).count() == 0


def test_panels_of_four(spark):
    edges = [20.8 + 52 * i for i in range(4)]
    cases = [(edges, [*range(20, 232)]), (None, [*range(30, 240)]), ([edges[0], edges[1] + 9, *edges[2:]], [*range(30, 240)]), ([edges[0], None, *edges[2:]], [*range(12, 240)]), (edges, [x for x in range(240) if x % 6 == 0])]
    pages, rows, pixels = pages_of(spark, 3, [inked for _, inked in cases], 30, 240)
    labels = spark.createDataFrame([(k, e) for k, (e, _) in enumerate(cases)], "k int, label_edges array<double>")
    got = {r["k"]: (r["labeled"], [tuple(s) for s in r["ranges"]]) for r in ranges.three_by_four(pixels, rows, pages.join(labels, "k").selectExpr("*", "0.8D AS pixels_per_mm", "25D AS speed"), ["k"]).collect()}
    assert got[0] == (True, [(20 + 52 * i, 70 + 52 * i, "label") for i in range(4)])
    assert got[1] == got[2] == (False, [(22, 72, "window")] + [(72 + 50 * i, 122 + 50 * i, "onset") for i in range(3)])  # no first panel begins later
    assert got[3] == (False, [(12 + 50 * i, 62 + 50 * i, "onset") for i in range(4)]) and 4 not in got


def twelve(spark, starts, ends, lean=0, grid=1.0, cal=None, width=240):
    """One page of twelve rows with ink from start to end of each row."""
    pages = spark.createDataFrame([(1, width, 170, 20.0, float(grid), cal)], "k int, width int, height int, speed double, grid_period double, calibration_end int")
    rows = spark.createDataFrame([(1, r, 12 * (r + 1), 1.0) for r in range(12)], "k int, row int, center int, pixels_per_mm double")
    pixels = spark.createDataFrame([(1, 12 * (r + 1), x, 0.9) for r in range(12) for x in range(starts[r], ends[r])], "k int, y int, x int, ink double")
    return pixels, rows, pages


def plain_line(values):
    axis = [12.0 * (r + 1) for r in range(12)]
    slope = float(np.median([(values[j] - values[i]) / (axis[j] - axis[i]) for i in range(12) for j in range(i + 1, 12)]))
    level = float(np.median([v - slope * a for v, a in zip(values, axis, strict=True)]))
    return [round(level + slope * a) for a in axis]


@pytest.mark.parametrize("spoilt, grid, kept", [((), 1.04, True), ((4,), 5.2, True), ((1, 5, 9), 1.0, True), ((0, 3, 6, 9), 1.0, False), ((), 1.3, False), ((), 3.0, False)])
def test_rows_agree_on_two_lines(spark, spoilt, grid, kept):
    starts = [14 + (r * 3) // 4 + (11 if r in spoilt else 0) for r in range(12)]
    ends = [216 + (r * 3) // 4 for r in range(12)]
    pixels, rows, pages = twelve(spark, starts, ends, grid=grid)
    found = ranges.twelve_consensus(pixels, rows, pages, ["k"]).collect()
    assert len(found) == kept
    if kept:
        want = list(zip(plain_line(starts), plain_line(ends), strict=True))
        assert [tuple(r) for r in found[0]["ranges"]] == want and found[0]["corrected"] == len(spoilt)
        assert found[0]["projected"] == sum((s, e) != w for s, e, w in zip(starts, ends, want, strict=True))
        assert found[0]["pixels_per_mm"] == pytest.approx(np.median([e - s for s, e in want]) / 200) and found[0]["grid_mm"] == (1.0 if grid < 3 else 5.0)


def test_a_pulse_is_no_beginning(spark):
    """Ink up to the pulse's end doesn't count; a page without one row has no ranges."""
    starts, ends = [15] * 12, [225] * 12
    pixels, rows, pages = twelve(spark, starts, ends, cal=20)
    assert [tuple(r) for r in ranges.twelve_consensus(pixels, rows, pages, ["k"]).first()["ranges"]] == [(21, 225)] * 12
    assert ranges.twelve_consensus(pixels.where("y <> 36"), rows, pages, ["k"]).count() == 0 and ranges.twelve_consensus(pixels, rows.where("row < 11"), pages, ["k"]).count() == 0
    assert ranges.twelve_consensus(pixels, rows, pages.withColumn("grid_period", F.lit(None).cast("double")), ["k"]).count() == 0


def test_row_origins(spark):
    starts = [14 + r // 2 for r in range(12)]
    spoilt = [s + (9 if r in (2, 7) else 0) for r, s in enumerate(starts)]
    page = ranges.twelve_origins(*twelve(spark, spoilt, [230] * 12), ["k"]).first()
    line = plain_line(spoilt)
    assert page["accepted"] and page["corrected"] == 2 and [r["start"] for r in page["ranges"]] == [line[r] if r in (2, 7) else s for r, s in enumerate(spoilt)]
    assert all(r["end"] - r["start"] == 200 for r in page["ranges"]) and page["residual"] == max(abs(a - b) for a, b in zip(spoilt, line, strict=True))
    wild = [14 + (12 if r % 2 else 0) for r in range(12)]
    page = ranges.twelve_origins(*twelve(spark, wild, [230] * 12), ["k"]).first()
    assert not page["accepted"] and page["ranges"] is None and page["corrected"] > 3
    # a short early run is stepped over unless the pulse's place is known; without lasting ink the densest window counts
    pixels, rows, pages = twelve(spark, starts, [230] * 12)
    early = pixels.union(pixels.where("x = 20").selectExpr("k", "y", "explode(sequence(3, 6)) AS x", "ink"))
    assert [r["start"] for r in ranges.twelve_origins(early, rows, pages, ["k"]).first()["ranges"]] == starts
    sparse = ranges.twelve_origins(pixels.where("x % 3 = 0"), rows, pages, ["k"]).first()
    assert sparse["accepted"] and all(r["start"] <= s + 2 for r, s in zip(sparse["ranges"], starts, strict=True))


def plain_spans(active):
    """(edge span, sustained span) of one row, column by column."""
    width = len(active)
    left, right = range(round(width * 0.04), round(width * 0.20) + 1), range(round(width * 0.80), round(width * 0.98) + 1)
    hole = lambda w: max((len(list(g)) for v, g in itertools.groupby(w) if not v), default=0)
    near, ahead, solid = max(32, round(width * 0.04)), max(24, round(width * 0.024)), max(5, round(width * 0.004))
    good = lambda w: len(w) == ahead and sum(w) / ahead >= 0.72 and hole(w) <= max(4, ahead // 4)
    s = next((x for x in left if active[x] and np.mean(active[x : x + near]) >= 0.45), None)
    e = next((x + 1 for x in reversed(right) if x < right[-1] and active[x] and np.mean(active[max(0, x + 1 - near) : x + 1]) >= 0.45), None)
    s2 = next((x for x in left if all(active[x : x + solid]) and good(active[x : x + ahead])), None)
    e2 = next((x for x in reversed(right) if all(active[x - solid : x]) and good(active[x - ahead : x])), None)
    return (s, e) if None not in (s, e) and e > s else None, (s2, e2) if None not in (s2, e2) and e2 > s2 else None


def test_spans_of_rows(spark):
    rng = random.Random(7)
    width, rows_of = 260, []
    for page in range(4):
        for r in range(12):
            start, end, share = rng.randint(5, 60), rng.randint(190, 258), rng.choice([0.6, 0.8, 0.9, 1.0])
            rows_of.append((page, r, [start <= x < end and rng.random() < share for x in range(width)]))
    pages = spark.createDataFrame([(k, width, 170, 20, 240, k * 15 - 5) for k in range(4)], "k int, width int, height int, start int, end int, tolerance int")
    rows = spark.createDataFrame([(k, r, 12 * (r + 1)) for k in range(4) for r in range(12)], "k int, row int, center int")
    pixels = spark.createDataFrame([(k, 12 * (r + 1) + (x + r) % 3 - 1, x, 0.7 if on else 0.69) for k, r, active in rows_of for x, on in enumerate(active)], "k int, y int, x int, ink double")
    spans = ranges.row_spans(pixels, rows, pages.select("k", "width", "height"), ["k"])
    got = {(r["k"], r["row"]): (r["edges"] and tuple(r["edges"]), r["sustained"] and tuple(r["sustained"])) for r in spans.collect()}
    want = {(k, r): plain_spans(active) for k, r, active in rows_of}
    assert got == want and len({w[1] is None for w in want.values()}) == 2
    said = {r["k"]: r["disagrees"] for r in ranges.disagrees(spans, pages.select("k", "start", "end", "tolerance"), ["k"], "edges").collect()}
    for k in range(4):
        mine = [want[k, r][0] for r in range(12)]
        ok = None not in mine and k * 15 - 5 >= 0 and abs(np.median([m[0] for m in mine]) - 20) <= k * 15 - 5 and abs(np.median([m[1] for m in mine]) - 240) <= k * 15 - 5
        assert said[k] == (not ok)
