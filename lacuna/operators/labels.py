"""The grid on which a page's lead names are printed: x and y as 1 + row + column + row * column, by least squares.

The normal equations of a page are one aggregate of sums, so a page may have any number of labels, repeated ones too. Their
matrix holds small whole numbers: rank and inverse come from its minors, which are exact. A page without four labels that
span the grid is refused for its rank; a label with a null place, or a name that isn't on the grid, is left out.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lacuna.plans import policy

from .ranges import fixed, whole

c = F.col
_TERMS = ("1", "r", "c", "rc")
_G = policy.LABEL_GRID


def _name(i: int, j: int) -> str:
    return f"_g{min(i, j)}{max(i, j)}"


def _det(rows: tuple[int, ...], columns: tuple[int, ...]) -> Column:
    """Determinant of a part of the normal matrix."""
    if not rows:
        return F.lit(1.0)
    if len(rows) == 1:
        return c(_name(rows[0], columns[0]))
    parts = [c(_name(rows[0], j)) * _det(rows[1:], columns[:k] + columns[k + 1 :]) * (-1) ** k for k, j in enumerate(columns)]
    return sum(parts[1:], parts[0])


def located(points: DataFrame) -> DataFrame:
    """points with row and column of their lead on the grid."""
    names = [n for line in policy.LABEL_ROWS for n in line]
    place = F.array_position(F.array(*map(F.lit, names)), c("lead")) - 1
    return points.withColumns({"row": F.floor(place / 4).cast("int"), "column": (place % 4).cast("int")}).where((place >= 0) & c("x").isNotNull() & c("y").isNotNull())


def at(fit: Column, row: Column | int, column: Column | int) -> Column:
    """A place on the grid; fit: array of four."""
    row, column = (F.lit(v) if isinstance(v, int) else v for v in (row, column))
    return fit[0] + fit[1] * row + fit[2] * column + fit[3] * row * column


def spacings(row: Column | int, column: Column | int) -> tuple[Column, Column]:
    """Distance to the next column and to the next row."""
    row, column = (F.lit(v) if isinstance(v, int) else v for v in (row, column))
    return c("x_fit")[2] + row * c("x_fit")[3], c("y_fit")[1] + column * c("y_fit")[3]


def fit(points: DataFrame, pages: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, x_fit, y_fit (arrays of four, null unless the rank is 4), failed (corner checks), strays (leads off their
    place), passed, mean_row, mean_column; points: by, lead, x, y; pages: by, width, height, font.
    """
    known = located(points).withColumns({"1": F.lit(1.0), "r": c("row").cast("double"), "c": c("column").cast("double")}).withColumn("rc", c("r") * c("c"))
    sums = [F.sum(c(a) * c(b)).alias(_name(i, j)) for (i, a), (j, b) in combinations([*enumerate(_TERMS)], 2)] + [F.sum(c(a) * c(a)).alias(_name(i, i)) for i, a in enumerate(_TERMS)] + [F.sum(c(a) * c(v)).alias(f"_{v}{i}") for v in ("x", "y") for i, a in enumerate(_TERMS)]
    page = pages.select(*by, "width", "height", "font").join(known.groupBy(*by).agg(*sums, F.collect_list(F.struct("lead", "row", "column", "x", "y")).alias("_points")), by, "left")
    minors = {k: [_det(s, s) for s in combinations(range(4), k)] for k in range(1, 5)}
    rank = F.lit(0)
    for k in range(1, 5):
        rank = F.when(F.greatest(*minors[k], F.lit(0.0)) > 0, F.lit(k)).otherwise(rank)
    others = lambda i: tuple(k for k in range(4) if k != i)
    page = fixed(page, rank=F.coalesce(rank, F.lit(0)), _det=_det((0, 1, 2, 3), (0, 1, 2, 3)), **{f"_c{i}{j}": _det(others(i), others(j)) * (-1) ** (i + j) for i in range(4) for j in range(i, 4)})
    cofactor = lambda i, j: c(f"_c{min(i, j)}{max(i, j)}")
    solved = lambda v: F.when(c("rank") == 4, F.array(*((cofactor(i, 0) * c(f"_{v}0") + cofactor(i, 1) * c(f"_{v}1") + cofactor(i, 2) * c(f"_{v}2") + cofactor(i, 3) * c(f"_{v}3")) / c("_det") for i in range(4))))
    page = fixed(page, x_fit=solved("x"), y_fit=solved("y"))

    within = lambda v, limits, of: (v > of * F.lit(limits[0])) & (v < of * F.lit(limits[1]))
    failed = []
    for row in (0, 3):
        for column in (0, 3):
            wide, high = spacings(row, column)
            dx, dy = c("x_fit")[1] + column * c("x_fit")[3], c("y_fit")[2] + row * c("y_fit")[3]
            checks = {"column_spacing": within(wide, _G["columns"], c("width")), "row_spacing": within(high, _G["rows"], c("height")), "horizontal_skew": F.abs(dx) < wide * F.lit(_G["skew"]), "vertical_skew": F.abs(dy) < high * F.lit(_G["skew"]), "font_height": within(c("font"), _G["font"], high), "jacobian": wide * high - dx * dy > 0}
            failed += [F.when(~F.coalesce(ok, F.lit(False)), F.lit(f"{name}:{row}:{column}")) for name, ok in checks.items()]

    def off(p: Column) -> Column:
        wide, high = spacings(p["row"], p["column"])
        limits = wide * F.lit(_G["x"]), F.greatest(c("font") * F.lit(_G["y_font"]), high * F.lit(_G["y"]))
        return ~((F.abs(at(c("x_fit"), p["row"], p["column"]) - p["x"]) < limits[0]) & (F.abs(at(c("y_fit"), p["row"], p["column"]) - p["y"]) < limits[1]))

    full = c("rank") == 4
    page = fixed(page, failed=F.when(full, F.filter(F.array(*failed), lambda f: f.isNotNull())), strays=F.when(full, F.array_sort(F.transform(F.filter("_points", off), lambda p: p["lead"]))))
    passed = F.coalesce(full & (F.size("failed") == 0) & (F.size("strays") == 0), F.lit(False))
    return page.select(*by, "width", "height", "font", "rank", "x_fit", "y_fit", "failed", "strays", passed.alias("passed"), (c("y_fit")[1] + 1.5 * c("y_fit")[3]).alias("mean_row"), (c("x_fit")[2] + 1.5 * c("x_fit")[3]).alias("mean_column"))


def rhythm_check(fits: DataFrame, rhythm: DataFrame, by: list[str]) -> DataFrame:
    """fits with x_off, y_off (from where the fourth row would begin) and rhythm_passed; rhythm: by, rhythm_x, rhythm_y."""
    both = fits.join(rhythm, by, "left")
    x_off, y_off = F.abs(c("rhythm_x") - at(c("x_fit"), 3, 0)), F.abs(c("rhythm_y") - at(c("y_fit"), 3, 0))
    ok = (x_off < spacings(3, 0)[0] * F.lit(_G["rhythm_x"])) & (y_off < c("y_fit")[1] * F.lit(_G["rhythm_y"]))
    return both.select("*", x_off.alias("x_off"), y_off.alias("y_off"), F.coalesce(ok, F.lit(False)).alias("rhythm_passed"))


def slots(fits: DataFrame, by: list[str]) -> DataFrame:
    """by, row, column, lead, left, top, right, bottom of the twelve labels and the rhythm label; fits: as of rhythm_check.

    None for a page of which a box would leave the image. Sides are rounded half to even; places are known to nine digits, so a
    half stays one whatever order its sums were taken in.
    """
    names = [(r, k, n) for r, line in enumerate(policy.LABEL_ROWS) for k, n in enumerate(line)]
    before, half, behind = (F.lit(v) * c("font") for v in _G["box"])

    side = lambda v: whole(F.round(v, 9))

    def box(row: int, column: int, lead: str, x: Column, y: Column) -> Column:
        return F.struct(F.lit(row).alias("row"), F.lit(column).alias("column"), F.lit(lead).alias("lead"), side(x - before).alias("left"), side(y - half).alias("top"), side(x + behind).alias("right"), side(y + half).alias("bottom"))

    boxes = [box(r, k, n, at(c("x_fit"), r, k), at(c("y_fit"), r, k)) for r, k, n in names] + [box(3, 0, "II", c("rhythm_x"), c("rhythm_y"))]
    made = fixed(fits.where((c("rank") == 4) & c("rhythm_x").isNotNull() & c("rhythm_y").isNotNull()), boxes=F.array(*boxes))
    sound = F.forall("boxes", lambda b: (b["left"] >= 0) & (b["left"] < b["right"]) & (b["right"] <= c("width")) & (b["top"] >= 0) & (b["top"] < b["bottom"]) & (b["bottom"] <= c("height")))
    return made.where(sound).select(*by, F.explode("boxes").alias("b")).select(*by, "b.*")
