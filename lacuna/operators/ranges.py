"""Where the time axis of a page lies: spans of source ink found from its columns, one row of columns at a time.

Pixels (by.., y, x, ink) meet the bands of a page's rows by an equal y; a band's strongest ink in a column is its support.
Whether a column is active is one flag for each column; a page then is one row with an array of their prefix sums, so that every span, window and run is read by plain expressions. The arrays are as long as a page is wide.

Pages (by.., width, height, and what each function names) without rows, or with another number of rows than a function is for,
or with a row outside of the page, have no ranges; so do pages with a null measure. Columns without ink count as empty. Rows
may repeat pixels: the strongest counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans import policy

c = F.col


def whole(x: Column) -> Column:
    """Rounded half to even, as an int."""
    return F.rint(x.cast("double")).cast("int")


def middle(values: Column) -> Column:
    """Median of an array without nulls."""
    s, n = F.array_sort(values), F.size(values)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def each(lo: Column, hi: Column) -> Column:
    """lo to hi, both included; empty if hi is less."""
    return F.when(hi >= lo, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))


def row_facts(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, centers (in order), spacing of a page's rows (by.., row, center)."""
    held = rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", F.col("center").cast("int").alias("center")))), lambda r: r["center"]).alias("centers"))
    gaps = F.transform(F.slice("centers", 2, F.size("centers")), lambda v, i: (v - F.get("centers", i)).cast("double"))
    return held.withColumn("spacing", F.when(F.size("centers") > 1, middle(gaps)))


def with_page(df: DataFrame, pages: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """df joined with its pages by a merge: both lie by page, and the tables grow with the pages behind generators of which an
    estimated size, that a broadcast would go by, knows nothing."""
    return df.join(pages.hint("merge"), by, how)


def supports(pixels: DataFrame, pages: DataFrame, by: list[str], radii: dict[str, Column]) -> DataFrame:
    """by, row (from 0), x and for each name of radii (columns over a page) the strongest ink within that distance of the row.

    Pixels are dealt by page, once: a page holds for each y the rows that are near, and everything behind stays by page.
    """
    widest = F.greatest(*radii.values()) if len(radii) > 1 else next(iter(radii.values()))
    bands = pages.select(*by, *(r.alias(f"_{n}") for n, r in radii.items()), widest.alias("_widest"), "centers").withColumn("_top", F.array_min("centers") - c("_widest"))
    near = lambda y: F.filter(F.transform("centers", lambda v, i: F.struct(i.alias("row"), F.abs(y - v).alias("off"))), lambda m: m["off"] <= c("_widest"))
    lines = bands.select(*by, *(f"_{n}" for n in radii), "_top", F.transform(each(c("_top"), F.array_max("centers") + c("_widest")), near).alias("_near"))
    met = with_page(pixels, lines, by).select(*by, "x", "ink", *(f"_{n}" for n in radii), F.explode(F.get("_near", (c("y") - c("_top")).cast("int"))).alias("_m"))
    return met.groupBy(*by, c("_m.row").alias("row"), "x").agg(*(F.max(F.when(c("_m.off") <= c(f"_{n}"), c("ink"))).alias(n) for n in radii))


def prefixed(columns: DataFrame, pages: DataFrame, by: list[str], keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """keys and for each name of flags an array: how many columns before x (0 to the width) hold the flag.

    columns: keys.., x (each once); pages: by.., width and whatever else a flag reads; keys begin with `by`.
    """
    placed = with_page(columns, pages, by, "right" if keys == by else "inner")
    on = lambda f: F.sort_array(F.collect_list(F.when(f & (c("x") >= 0) & (c("x") < c("width")), c("x").cast("int"))))
    listed = placed.groupBy(*keys).agg(F.first("width").cast("int").alias("_w"), *(on(f).alias(f"_{n}") for n, f in flags.items()))
    ends = listed.select(*keys, *(F.concat(F.array(F.lit(-1)), c(f"_{n}"), F.array("_w")).alias(f"_{n}") for n in flags))
    held = lambda n: F.flatten(F.transform(F.sequence(F.lit(0), F.size(f"_{n}") - 2), lambda i: F.array_repeat(i, F.get(f"_{n}", i + 1) - F.get(f"_{n}", i))))
    return ends.select(*keys, *(held(n).alias(n) for n in flags))


def inside(cum: Column, lo: Column, hi: Column) -> Column:
    """How many of the columns from lo on, before hi, hold the flag."""
    return F.get(cum, hi) - F.get(cum, lo)


def held_at(cum: Column, x: Column) -> Column:
    return inside(cum, x, x + 1) == 1


def no_hole_beyond(cum: Column, lo: Column, hi: Column, most: Column) -> Column:
    """Whether no more than `most` columns in a row lack the flag from lo on, before hi."""
    return ~F.exists(each(lo, hi - most - 1), lambda y: inside(cum, y, y + most + 1) == 0)


def best_window(cum: Column, lo: Column, hi: Column, width: Column) -> Column:
    """(score, start) of the first window of a width with most columns, starting from lo to hi; null if there is none."""
    found = F.array_max(F.transform(each(lo, hi), lambda s: F.struct(inside(cum, s, s + width).alias("score"), (-s).alias("start"))))
    return F.when(found.isNotNull(), F.struct(found["score"].alias("score"), (-found["start"]).alias("start")))


def runs(cum: Column, width: Column) -> Column:
    """(start, size) of all runs of columns that hold the flag, in order."""
    starts = F.filter(each(F.lit(0), width - 1), lambda x: held_at(cum, x) & ((x == 0) | ~held_at(cum, F.greatest(x - 1, F.lit(0)))))
    ends = F.filter(each(F.lit(1), width), lambda x: held_at(cum, x - 1) & ((x == width) | ~held_at(cum, F.least(x, width - 1))))
    return F.transform(starts, lambda s, i: F.struct(s.alias("start"), (F.get(ends, i) - s).alias("size")))


def fixed(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are computed once a row. Behind a generator neither a filter, which would be pushed down, nor a
    lambda of a later projection repeats them."""
    keep = [n for n in df.columns if n not in columns]
    once = df.select(*keep, F.explode(F.array(F.struct(*(v.alias(n) for n, v in columns.items())))).alias("_once"))
    return once.select(*keep, *(c("_once")[n].alias(n) for n in columns))


def present(x: Column) -> Column:
    """Rows where x isn't null; exploded, since a filter on it would be pushed down and evaluate it twice."""
    return F.explode(F.filter(F.array(x), lambda v: v.isNotNull()))


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def _ready(pages: DataFrame, rows: DataFrame, by: list[str], n_rows: int, seconds: float, reach: list[float | int]) -> DataFrame:
    """Pages with their rows and the width of a panel in columns, without those that no rule can be used on."""
    share, least = reach
    held = with_page(pages, row_facts(rows, by), by).where(F.size("centers") == n_rows).withColumn("duration", whole(c("pixels_per_mm") * c("speed") * F.lit(seconds)))
    radius = F.greatest(F.lit(least), whole(c("spacing") * F.lit(share)))
    return held.withColumn("narrow_radius", radius).where((F.array_min("centers") + radius >= 0) & (F.array_max("centers") - radius < c("height")) & (c("duration") >= policy.TIME_RANGES["least"]) & (c("width") > 0))


def _shared(support: DataFrame, by: list[str], n_rows: int, name: str = "narrow") -> DataFrame:
    """by, x, shared: the median support of a page's rows in a column, 0 where a row has no ink."""
    values = F.collect_list(name)
    padded = F.concat(values, F.array_repeat(F.lit(0.0), n_rows - F.size(values)))
    wide = [F.count_if(c("wide") >= policy.BAND).alias("rows")] if "wide" in support.columns else []
    return support.groupBy(*by, "x").agg(middle(padded).alias("shared"), *wide)


def six_by_two(pixels: DataFrame, rows: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, method, left, right (start, end) of the two panels of five seconds; pages has pixels_per_mm and speed (mm a second).

    First choice are two runs of a panel's length in which half of the rows have ink; then one run of both panels' length, cut
    in two if they overlap; else the windows with most shared ink near the rows, of which the left one may be moved to end at
    the gutter. Refused pages don't appear.
    """
    p, share = policy.SIX_BY_TWO, policy.TIME_RANGES["share"]
    ready = _ready(pages, rows, by, 6, p["seconds"], [p["narrow"], 2]).where(c("duration") <= c("width") * F.lit(p["widest"]))
    found = supports(pixels, ready, by, {"narrow": c("narrow_radius"), "wide": F.greatest(F.lit(3), whole(c("spacing") * F.lit(p["wide"])))})
    sums = prefixed(_shared(found, by, 6), ready.select(*by, "width"), by, by, {"active": c("shared") >= policy.BAND, "inked": c("rows") >= 3})
    d, w = c("duration"), c("width")
    page = with_page(sums, ready.select(*by, "width", "duration"), by).withColumn("sustained", F.filter(runs(c("inked"), w), lambda r: r["size"] >= d * F.lit(p["sustained"])))
    between = lambda r, limits: (r["size"] >= d * F.lit(limits[0])) & (r["size"] <= d * F.lit(limits[1]))
    single, double = F.filter("sustained", lambda r: between(r, p["single"])), F.filter("sustained", lambda r: between(r, p["double"]))
    page = page.withColumns({"single": single, "double": double})

    # two runs of a panel each
    first, last = F.get("single", F.lit(0)), F.try_element_at("single", F.lit(-1))
    last_end = last["start"] + last["size"]
    pair = F.when((F.size("single") >= 2) & (first["start"] + d <= last_end - d), F.struct(_span(first["start"], first["start"] + d).alias("left"), _span(last_end - d, last_end).alias("right"), F.lit("runs").alias("method")))

    # one run of both
    nearest = F.array_min(F.transform("double", lambda r: F.struct(F.abs(r["size"] - d * 2).alias("off"), r["start"].alias("start"), r["size"].alias("size"))))
    end, half = nearest["start"] + nearest["size"], whole(nearest["size"] / 2)
    cut = whole((nearest["start"] + end) / 2)
    whole_run = F.when(nearest["start"] + d <= end - d, F.struct(_span(nearest["start"], nearest["start"] + d).alias("left"), _span(end - d, end).alias("right"), F.lit("double_run").alias("method")))
    split = F.when((half >= policy.TIME_RANGES["least"]) & (F.abs(half - d) <= d * F.lit(p["split"])), F.struct(_span(nearest["start"], cut).alias("left"), _span(cut, end).alias("right"), F.lit("split_run").alias("method")))

    # the densest windows
    def window(k: int) -> Column:
        lo, hi = (whole((k + F.lit(s)) * w / 2) for s in p["search"])
        return best_window(c("active"), F.greatest(F.lit(0), lo), F.least(w - d, hi), d)

    page = page.withColumns({"first_choice": F.coalesce(pair, whole_run, split), "l": window(0), "r": window(1)})
    enough = (c("l.score") >= d * F.lit(share)) & (c("r.score") >= d * F.lit(share))
    lo, hi = whole(w * F.lit(p["gutter"][0])), F.least(w, whole(w * F.lit(p["gutter"][1])))
    holes = F.aggregate(each(lo, hi - 1), F.struct(F.lit(0).alias("run"), F.lit(0).alias("size"), F.lit(0).alias("start")), lambda s, x: F.when(held_at(c("active"), x), F.struct(F.lit(0).alias("run"), s["size"].alias("size"), s["start"].alias("start"))).otherwise(F.struct((s["run"] + 1).alias("run"), F.greatest(s["size"], s["run"] + 1).alias("size"), F.when(s["run"] + 1 > s["size"], x - s["run"]).otherwise(s["start"]).alias("start"))))
    page = page.withColumn("gutter", holes)
    end = c("gutter.start")
    moved = (c("l.start") < w * F.lit(p["early"])) & (c("gutter.size") >= F.greatest(F.lit(4), whole(w * F.lit(p["gutter_run"])))) & (end - d >= 0) & (end - d >= c("l.start") + w * F.lit(p["later"])) & (end <= c("r.start")) & (c("r.start") - end <= w * F.lit(p["apart"])) & (inside(c("active"), F.greatest(end - d, F.lit(0)), end) >= c("l.score") * F.lit(p["kept"]))
    left = F.when(moved, end - d).otherwise(c("l.start"))
    windows = F.when(enough & (left + d <= c("r.start")), F.struct(_span(left, left + d).alias("left"), _span(c("r.start"), c("r.start") + d).alias("right"), F.when(moved, "window_to_gutter").otherwise("windows").alias("method")))
    return page.select(*by, present(F.coalesce("first_choice", windows)).alias("choice")).select(*by, "choice.method", "choice.left", "choice.right")


def three_by_four(pixels: DataFrame, rows: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, labeled, ranges (four of start, end, method) of the panels of two and a half seconds.

    pages has pixels_per_mm, speed and label_edges (the left edges of four labels, or null). Labels count if their distances
    and the ink behind each agree with the panel's length; else each panel begins at the first sustained ink behind the one
    before it, or where most ink is. Refused pages don't appear.
    """
    p, t = policy.THREE_BY_FOUR, policy.TIME_RANGES
    d, w = c("duration"), c("width")
    ready = _ready(pages, rows, by, 3, p["seconds"], [p["narrow"], 2]).where(d <= w / 4 * F.lit(p["widest"]))
    found = supports(pixels, ready, by, {"narrow": c("narrow_radius")})
    page = with_page(prefixed(_shared(found, by, 3), ready.select(*by, "width"), by, by, {"active": c("shared") >= policy.BAND}), ready.select(*by, "width", "duration", "label_edges", "pixels_per_mm"), by)

    active, slack = c("active"), F.greatest(F.lit(4), whole(d * F.lit(p["label"])))
    page = page.withColumn("starts", F.transform("label_edges", lambda e: whole(e - c("pixels_per_mm"))))
    start = lambda k: F.get("starts", F.lit(k))
    fits = (F.size("starts") == 4) & ~F.exists("label_edges", lambda e: e.isNull() | F.isnan(e)) & (start(0) >= 0) & (start(3) + d <= w)
    for k in range(3):
        fits = fits & (F.abs(start(k + 1) - start(k) - d) <= slack) & (start(k) + d <= start(k + 1) + slack)
    for k in range(4):
        fits = fits & (start(k) >= 0) & (start(k) + d <= w) & (inside(active, start(k), start(k) + d) >= d * F.lit(t["share"]))
    page = page.withColumn("labeled", F.coalesce(c("starts").isNotNull() & fits, F.lit(False)))

    ahead, hole = F.greatest(F.lit(12), whole(d * F.lit(p["window"]))), None
    hole = F.greatest(F.lit(4), F.floor(ahead / 3).cast("int"))
    spans: list[Column] = []
    for k in range(4):  # each search begins where the panel before ended
        lo = F.greatest(F.lit(0), whole(w / 4 * F.lit(p["search"][0]))) if k == 0 else c(f"p{k - 1}.end")
        hi = F.least(w - d, whole((k + F.lit(p["search"][1])) * w / 4))
        onset = F.get(F.filter(each(lo, hi), lambda s: held_at(active, s) & (inside(active, s, s + ahead) / ahead >= F.lit(t["onset"])) & no_hole_beyond(active, s, s + ahead, hole)), F.lit(0))
        page = page.withColumns({f"_onset{k}": onset, f"_window{k}": best_window(active, lo, hi, d)})
        dense = F.when(c(f"_window{k}.score") >= d * F.lit(t["share"]), c(f"_window{k}.start"))
        first = F.coalesce(f"_onset{k}", dense)
        page = page.withColumn(f"p{k}", F.when(first.isNotNull(), F.struct(first.cast("int").alias("start"), (first + d).cast("int").alias("end"), F.when(c(f"_onset{k}").isNotNull(), "onset").otherwise("window").alias("method"))))
        spans.append(c(f"p{k}"))
    by_label = F.array(*(F.struct(start(k).alias("start"), (start(k) + d).alias("end"), F.lit("label").alias("method")) for k in range(4)))
    ranges = F.when(c("labeled"), by_label).when(F.forall(F.array(*spans), lambda s: s.isNotNull()), F.array(*spans))
    return page.select(*by, "labeled", present(ranges).alias("ranges"))


def _robust_line(values: Column, axis: Column) -> Column:
    """Theil-Sen: values of the line by the median of all pairwise slopes and the median rest, rounded; null if all places are one."""
    n = F.size(axis)
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n - 2), lambda i: F.transform(F.sequence(i + 1, n - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    apart = F.filter(pairs, lambda p: F.get(axis, p["i"]) != F.get(axis, p["j"]))
    slope = middle(F.transform(apart, lambda p: (F.get(values, p["j"]) - F.get(values, p["i"])) / (F.get(axis, p["j"]) - F.get(axis, p["i"]))))
    return F.when(F.size(apart) > 0, F.struct(slope.alias("slope"), axis.alias("axis"), values.alias("values")))


def _predicted(line: Column) -> Column:
    """Rounded places of a robust line on its own axis."""
    level = middle(F.transform(line["values"], lambda v, i: v - line["slope"] * F.get(line["axis"], i)))
    return F.transform(line["axis"], lambda a: whole(level + line["slope"] * a))


def _line(values: Column, axis: Column) -> Column:
    """Means and slope of the least squares line; places must differ."""
    both = F.zip_with(values, axis, lambda v, a: F.struct(v.alias("v"), a.alias("a")))
    zero = F.struct(*(F.lit(0.0).alias(n) for n in ("v", "a", "va", "aa")))
    add = lambda s, x: F.struct((s["v"] + x["v"]).alias("v"), (s["a"] + x["a"]).alias("a"), (s["va"] + x["v"] * x["a"]).alias("va"), (s["aa"] + x["a"] * x["a"]).alias("aa"))
    n = F.size(axis)
    return F.aggregate(both, zero, add, lambda s: F.struct((s["v"] / n).alias("v"), (s["a"] / n).alias("a"), ((s["va"] - s["v"] * s["a"] / n) / (s["aa"] - s["a"] * s["a"] / n)).alias("slope")))


def _most_off(values: Column, axis: Column, line: Column) -> Column:
    """The largest distance from a line."""
    return F.array_max(F.zip_with(values, axis, lambda v, a: F.abs(v - line["v"] - line["slope"] * (a - line["a"]))))


def _rows_together(found: DataFrame, by: list[str], fields: list[str], n_rows: int) -> DataFrame:
    """by and, for each of the fields, an array by row; pages of which a row is missing are left out."""
    listed = found.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", *fields))).alias("_r")).where(F.size("_r") == n_rows)
    return listed.select(*by, *(F.col("_r")[f].alias(f) for f in fields))


def edge_span(cum: Column, width: Column) -> Column:
    """(start, end) of a row's trace: the first column on the left and the last on the right that begin or end a stretch in
    which enough columns have ink; null where either is missing or they don't follow each other."""
    p = policy.TWELVE
    ahead = F.greatest(F.lit(32), whole(width * F.lit(p["window"])))
    left, right = (tuple(whole(width * F.lit(s)) for s in p[side]) for side in ("left", "right"))
    enough = lambda lo, hi: inside(cum, lo, hi) / (hi - lo) >= F.lit(p["continuity"])
    start = F.get(F.filter(each(left[0], F.least(left[1], width - 1)), lambda x: held_at(cum, x) & enough(x, F.least(width, x + ahead))), F.lit(0))
    end = F.try_element_at(F.filter(each(right[0] + 1, F.least(right[1], width)), lambda e: held_at(cum, e - 1) & enough(F.greatest(F.lit(0), e - ahead), e)), F.lit(-1))
    return F.when((width >= 100) & (end > start), _span(start, end))


def sustained_span(cum: Column, width: Column) -> Column:
    """(start, end) of a row's trace whose first and last stretch begin and end in a solid run, are dense, and have short holes
    only; null where either is missing."""
    s, p = policy.SUSTAINED, policy.TWELVE
    ahead, solid = F.greatest(F.lit(s["least"]), whole(width * F.lit(s["window"]))), F.greatest(F.lit(s["run_least"]), whole(width * F.lit(s["run"])))
    hole = F.greatest(F.lit(s["hole_least"]), F.floor(ahead / 4).cast("int"))
    left, right = (tuple(whole(width * F.lit(v)) for v in p[side]) for side in ("left", "right"))
    good = lambda lo, hi: (inside(cum, lo, hi) / ahead >= F.lit(s["share"])) & no_hole_beyond(cum, lo, hi, hole)
    start = F.get(F.filter(each(left[0], F.least(left[1], width - ahead)), lambda x: (inside(cum, x, x + solid) == solid) & good(x, x + ahead)), F.lit(0))
    end = F.try_element_at(F.filter(each(F.greatest(right[0], ahead), right[1]), lambda e: (inside(cum, e - solid, e) == solid) & good(e - ahead, e)), F.lit(-1))
    return F.when((width >= 100) & (end > start), _span(start, end))


def row_spans(pixels: DataFrame, rows: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, row, edges, sustained (start, end or null) of every row of pages with twelve rows; pages: by.., width, height."""
    p = policy.TWELVE
    held = with_page(pages, row_facts(rows, by), by).where(F.size("centers") == 12).withColumn("radius", F.greatest(F.lit(2), whole(c("spacing") * F.lit(p["band"]))))
    sums = with_page(prefixed(supports(pixels, held, by, {"ink": c("radius")}), held.select(*by, "width"), by, [*by, "row"], {"cum": c("ink") >= p["support"]}), held.select(*by, "width"), by)
    return sums.select(*by, "row", edge_span(c("cum"), c("width")).alias("edges"), sustained_span(c("cum"), c("width")).alias("sustained"))


def disagrees(spans: DataFrame, pages: DataFrame, by: list[str], span: str) -> DataFrame:
    """by, disagrees: whether a page's own range (start, end, tolerance) lies off the median start or end of its twelve rows;
    a page without all of them, or with a negative tolerance, disagrees."""
    found = spans.where(c(span).isNotNull()).groupBy(*by).agg(F.count("*").alias("_n"), F.percentile(f"{span}.start", F.lit(0.5)).alias("_s"), F.percentile(f"{span}.end", F.lit(0.5)).alias("_e"))
    both = with_page(pages, found, by, "left")
    agrees = (c("_n") == 12) & (c("tolerance") >= 0) & (F.abs(c("_s") - c("start")) <= c("tolerance")) & (F.abs(c("_e") - c("end")) <= c("tolerance"))
    return both.select(*by, (~F.coalesce(agrees, F.lit(False))).alias("disagrees"))


def twelve_consensus(pixels: DataFrame, rows: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, ranges (start, end of each of twelve rows), corrected, projected, pixels_per_mm, grid_mm, scale_error.

    Every row says by itself where its trace begins and ends; all twelve must agree on two straight lines, at most three of
    them with a gross error, and every row is put onto these lines. Their length and the page's grid period must agree on a
    grid of one or five millimetres. pages has grid_period, speed and calibration_end (columns up to it hold a pulse, or null).
    Refused pages don't appear.
    """
    p, w = policy.TWELVE, c("width")
    held = with_page(pages.where((c("grid_period") > 0) & (c("grid_period") < float("inf")) & (c("speed") > 0) & (c("speed") < float("inf"))), row_facts(rows, by), by).where(F.size("centers") == 12)
    held = held.withColumn("radius", F.greatest(F.lit(2), whole(c("spacing") * F.lit(p["band"])))).where((F.array_min("centers") + c("radius") >= 0) & (F.array_max("centers") - c("radius") < c("height")) & (w >= 100))
    found = supports(pixels, held, by, {"ink": c("radius")})
    flag = (c("ink") >= p["support"]) & (c("calibration_end").isNull() | (c("x") > c("calibration_end")))
    spans = with_page(prefixed(found, held.select(*by, "width", "calibration_end"), by, [*by, "row"], {"cum": flag}), held.select(*by, "width"), by)
    spans = spans.select(*by, "row", present(edge_span(c("cum"), w)).alias("span"))
    page = _rows_together(spans.select(*by, "row", c("span.start").cast("double").alias("starts"), c("span.end").cast("double").alias("ends")), by, ["starts", "ends"], 12)
    page = with_page(page, held.select(*by, "width", "grid_period", "speed", F.transform("centers", lambda x: x.cast("double")).alias("axis")), by)

    at_edge = lambda name, cond: F.size(F.filter(name, cond)) <= p["edges"]
    page = page.where(at_edge("starts", lambda s: s <= whole(w * F.lit(p["left"][0]))) & at_edge("ends", lambda e: e >= whole(w * F.lit(p["right"][1]))))
    page = fixed(fixed(page, l1=_robust_line(c("starts"), c("axis")), l2=_robust_line(c("ends"), c("axis"))), s=_predicted(c("l1")), e=_predicted(c("l2")))
    paper, every = c("speed") * F.lit(p["seconds"]), F.sequence(F.lit(0), F.lit(11))
    length = lambda end, start: middle(F.transform(end, lambda e, i: (e - F.get(start, i)).cast("double"))) / paper
    page = fixed(page, first_mm=length("ends", "starts"), pixels_per_mm=length("e", "s"))
    page = fixed(page, slack=F.greatest(F.lit(2), F.ceil(c("first_mm") * F.lit(p["tolerance_mm"])).cast("int")), ratio=c("grid_period") / c("pixels_per_mm"))
    off = F.size(F.filter(every, lambda i: (F.abs(F.get("starts", i) - F.get("s", i)) > c("slack")) | (F.abs(F.get("ends", i) - F.get("e", i)) > c("slack"))))
    sound = F.forall(every, lambda i: ((F.get("e", i) - F.get("s", i)) / w).between(*p["span"]))
    moved = F.size(F.filter(every, lambda i: (F.get("starts", i) != F.get("s", i)) | (F.get("ends", i) != F.get("e", i))))
    page = fixed(page, corrected=off, projected=moved, sound=sound, grid_mm=F.when(F.abs(c("ratio") - 1) <= F.abs(c("ratio") - 5), F.lit(1.0)).otherwise(F.lit(5.0)))
    page = fixed(page, scale_error=F.abs(c("ratio") - c("grid_mm")) / c("grid_mm"))
    good = page.where(c("first_mm").between(*p["mm"]) & (c("corrected") <= p["corrected"]) & c("sound") & (c("scale_error") <= p["scale"]))
    return good.select(*by, F.transform("s", lambda s, i: _span(s, F.get("e", i))).alias("ranges"), "corrected", "projected", "pixels_per_mm", "grid_mm", "scale_error")


def twelve_origins(pixels: DataFrame, rows: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, accepted, ranges (start, end of each of twelve rows; null if refused), corrected, residual (largest, in columns).

    Each row's length follows from its own scale (rows has pixels_per_mm); it begins at its first sustained ink behind the
    calibration pulse, or where most ink is. The beginnings must lie on a robust line but for three rows, which are put onto
    it; then beginnings and ends must lie near straight lines and not too far apart. Pages of which a row has no beginning, or
    whose measures can't be used, don't appear; pages whose rows disagree appear as not accepted.
    """
    o, p, t, w, d = policy.TWELVE_ORIGIN, policy.TWELVE, policy.TIME_RANGES, c("width"), c("duration")
    held = with_page(pages, row_facts(rows, by), by).where(F.size("centers") == 12).withColumn("radius", F.greatest(F.lit(2), whole(c("spacing") * F.lit(p["origin_band"])))).where((F.array_min("centers") + c("radius") >= 0) & (F.array_max("centers") - c("radius") < c("height")))
    found = supports(pixels, held, by, {"ink": c("radius")})
    scaled = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("row", F.col("center").cast("int").alias("center"), "pixels_per_mm"))).alias("_scales"))
    sums = with_page(prefixed(found, held.select(*by, "width"), by, [*by, "row"], {"cum": c("ink") >= policy.BAND}), held.select(*by, "width", "speed", "calibration_end"), by)
    sums = with_page(sums, scaled, by).withColumn("mm", F.get("_scales", c("row"))["pixels_per_mm"]).drop("_scales")
    each_row = sums.where(c("mm").between(*p["mm"])).withColumn("duration", whole(c("mm") * c("speed") * F.lit(p["seconds"]))).where((d >= o["least"]) & (d <= w * F.lit(o["widest"])))
    lo, hi = F.greatest(F.lit(0), whole(w * F.lit(o["first"])), F.coalesce(c("calibration_end"), F.lit(0))), F.least(w - d, whole(w * F.lit(o["last"])))
    each_row = fixed(each_row, lo=lo, hi=hi).where(c("hi") >= c("lo"))
    # without a known pulse, short early runs of ink are stepped over
    early, pulse = F.least(c("hi") + 1, F.greatest(c("lo"), whole(w * F.lit(o["early"])))), F.greatest(F.lit(3), whole(c("mm") * F.lit(o["pulse_mm"])))
    ahead = F.greatest(F.lit(8), whole(d * F.lit(o["onset"])), whole(c("mm") * F.lit(o["onset_mm"])))
    each_row = fixed(each_row, early=early, pulse=pulse, ahead=ahead, hole=F.greatest(F.lit(3), F.floor(ahead / 4).cast("int")))
    heads = F.filter(each(c("lo"), c("early") - 1), lambda x: held_at(c("cum"), x) & ((x == c("lo")) | ~held_at(c("cum"), F.greatest(x - 1, F.lit(0)))) & (x <= w * F.lit(o["early_run"])))
    tail = lambda x: F.coalesce(F.get(F.filter(each(x, c("early") - 1), lambda y: ~held_at(c("cum"), y)), F.lit(0)), c("early"))
    passed = F.array_max(F.transform(F.filter(F.transform(heads, lambda x: F.struct(x.alias("x"), tail(x).alias("end"))), lambda r: r["end"] - r["x"] <= c("pulse")), lambda r: r["end"]))
    each_row = fixed(each_row, origin=F.when(c("calibration_end").isNull(), F.greatest(c("lo"), F.coalesce(passed, c("lo")))).otherwise(c("lo"))).where(c("origin") <= c("hi"))
    until = lambda s: F.least(w, s + c("ahead"))
    onset = F.get(F.filter(each(c("origin"), c("hi")), lambda s: held_at(c("cum"), s) & (inside(c("cum"), s, until(s)) / (until(s) - s) >= F.lit(t["onset"])) & no_hole_beyond(c("cum"), s, until(s), c("hole"))), F.lit(0))
    each_row = fixed(each_row, onset=onset, dense=best_window(c("cum"), c("origin"), c("hi"), d))
    begin = F.coalesce("onset", F.when(c("dense.score") >= d * F.lit(t["share"]), c("dense.start")))
    found_rows = each_row.select(*by, "row", "duration", "mm", present(begin).alias("start"))

    page = _rows_together(found_rows.select(*by, "row", c("start").cast("double").alias("starts"), c("duration").alias("lengths"), c("mm").alias("scales")), by, ["starts", "lengths", "scales"], 12)
    page = fixed(with_page(page, held.select(*by, "width", F.transform("centers", lambda x: x.cast("double")).alias("axis")), by), line=_robust_line(c("starts"), c("axis"))).where("line is not null")
    page = fixed(page, predicted=_predicted(c("line")), slack=F.greatest(F.lit(2), F.ceil(middle(c("scales")) * F.lit(p["tolerance_mm"])).cast("int")))
    page = fixed(page, rest=F.transform("starts", lambda s, i: F.abs(s - F.get("predicted", i))))
    page = fixed(page, corrected=F.size(F.filter("rest", lambda r: r > c("slack"))))
    page = fixed(page, s=F.transform("starts", lambda s, i: F.when((c("corrected") <= p["corrected"]) & (F.get("rest", i) > c("slack")), F.get("predicted", i).cast("double")).otherwise(s)))
    page = fixed(page, e=F.transform("s", lambda s, i: s + F.get("lengths", i)))
    page = fixed(page, start_line=_line(c("s"), c("axis")), end_line=_line(c("e"), c("axis")))
    spread = lambda name: F.array_max(name) - F.array_min(name)
    straight = (_most_off(c("s"), c("axis"), c("start_line")) <= w * F.lit(o["start_fit"])) & (_most_off(c("e"), c("axis"), c("end_line")) <= w * F.lit(o["end_fit"])) & (spread("s") <= w * F.lit(o["spread"])) & (spread("e") <= w * F.lit(o["spread"]))
    page = fixed(page, accepted=F.coalesce((c("corrected") <= p["corrected"]) & straight, F.lit(False)))
    return page.select(*by, "accepted", F.when(c("accepted"), F.transform("s", lambda s, i: _span(s, F.get("e", i)))).alias("ranges"), "corrected", F.array_max("rest").cast("int").alias("residual"))
