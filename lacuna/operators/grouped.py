"""Kernels by series: grouped maps over Arrow. A group is one series or one panel of a raster, bounded by its length."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.functions import kernels


def aligned_pairs(series: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, scale, shift, offset, rmse of each pair; series: series, values (array)."""
    left = series.select(F.col("series").alias("a"), F.col("values").alias("va"))
    right = series.select(F.col("series").alias("b"), F.col("values").alias("vb"))
    return searched(pairs.select("a", "b").join(left, "a").join(right, "b"), [])


def searched(pairs: DataFrame, by: list[str]) -> DataFrame:
    """by, a, b, scale, shift, offset, rmse of pairs that hold their values (va, vb); null where no hypothesis has enough samples.

    Pairs are dealt to a fixed number of tasks, since their rows are small and the work on them isn't; a task searches all
    hypotheses of a block of pairs at once.
    """
    keys = [*by, "a", "b"]

    def search(it):
        for pdf in it:
            sizes = pd.DataFrame({"n": pdf["va"].map(len), "m": pdf["vb"].map(len)})
            found = {name: np.full(len(pdf), np.nan) for name in ("scale", "shift", "offset", "rmse")}
            for (n, m), rows in sizes.groupby(["n", "m"]).indices.items():
                if not n or not m:
                    continue
                grid = lambda name, k: np.array(pdf[name].iloc[rows].tolist(), float).reshape(len(rows), k)  # noqa: E731, B023
                got = kernels.align_many(grid("va", n), grid("vb", m))
                met = np.isfinite(got[3])
                for name, values in zip(found, got, strict=True):
                    found[name][rows[met]] = values[met]
            out = pdf[keys].copy()
            for name, values in found.items():
                out[name] = pd.array(np.where(np.isnan(values), 0, values), "Int32" if name == "shift" else "Float64")
                out.loc[np.isnan(values), name] = pd.NA
            yield out

    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = ", ".join(f"`{k}` {pairs.schema[k].dataType.simpleString()}" for k in keys)
    return pairs.select(*keys, "va", "vb").repartition(tasks, *keys).mapInPandas(search, f"{fields}, scale double, shift int, offset double, rmse double")


def peaks(df: DataFrame, by: str, distance: int, height: float, prominence: float) -> DataFrame:
    def run(pdf):
        pdf = pdf.sort_values("sample")
        at = kernels.peaks(pdf["value"].to_numpy(float), distance, height, prominence)
        return pd.DataFrame({by: pdf[by].iloc[0], "sample": pdf["sample"].to_numpy()[at], "value": pdf["value"].to_numpy()[at]})

    return df.select(by, "sample", "value").where("value is not null").groupBy(by).applyInPandas(run, f"{by} long, sample int, value double")


def clusters(events: DataFrame, by: str, tolerance: float, least: int) -> DataFrame:
    """by, time, n of event clusters; events: by, time, series. The key should bound the events, such as a page or a day."""

    def run(pdf):
        found = kernels.event_clusters(list(zip(pdf["time"].tolist(), pdf["series"].tolist(), strict=True)), tolerance, least)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(found), "time": [t for t, _ in found], "n": np.array([n for _, n in found], np.int32)})

    return events.select(by, "time", "series").groupBy(by).applyInPandas(run, f"{by} long, time double, n int")


def traced(panels: DataFrame, center_weight: float = 0.35, transition: float = 1.0) -> DataFrame:
    """panel, x, y of the cheapest path; panels: panel, x, y_start, row_center, evidence (array by row from y_start).

    A pixel costs 7 for missing evidence and, by the fourth power, its distance from the row's centre in half heights. A panel
    is one row's band of an image, which bounds the group.
    """

    def run(pdf):
        pdf = pdf.sort_values("x")
        grid = np.array(pdf["evidence"].tolist(), float).T
        start, half = int(pdf["y_start"].iloc[0]), max(grid.shape[0] / 2, 1.0)
        far = np.abs(np.arange(start, start + grid.shape[0]) - float(pdf["row_center"].iloc[0])) / half
        y = kernels.best_path(7 * (1 - grid) + center_weight * far[:, None] ** 4, 0.035 * transition, 0.0018 * transition) + start
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "x": pdf["x"].to_numpy(), "y": y.astype(np.int32)})

    return panels.select("panel", "x", "y_start", "row_center", "evidence").groupBy("panel").applyInPandas(run, "panel long, x int, y int")


def crossings(panels: DataFrame, scale: float = 1.0, reward: float = 0.0, radius: int = 0, excursion: float = 0.0) -> DataFrame:
    """panel, x, y of paths that may cross their neighbours' bands.

    panels: panel, x, y_start, row_center, row_spacing, evidence (array by row from y_start), and if there are events, anchor
    (whether one is at x) and reference (the row of a first path at x; null throughout if there is none). With a reference
    only ink that is joined to it earns the excursion. A panel is one row's reach in an image, which bounds the group; columns
    must follow each other, and a panel of fewer than three columns or rows has no path.
    """

    def run(pdf):
        pdf = pdf.sort_values("x")
        grid, start = np.array(pdf["evidence"].tolist(), float).T, int(pdf["y_start"].iloc[0])
        if min(grid.shape) < 3:
            return pd.DataFrame({"panel": [], "x": [], "y": []}).astype({"panel": "int64", "x": "int32", "y": "int32"})
        anchors, reference = np.flatnonzero(pdf["anchor"].fillna(False).to_numpy(bool)), pdf["reference"].to_numpy(float)
        support = kernels.event_support(grid, start, reference, anchors, radius) if radius and len(anchors) and not np.isnan(reference).any() else None
        y = kernels.crossing_path(grid, start, float(pdf["row_center"].iloc[0]), float(pdf["row_spacing"].iloc[0]), scale, reward, anchors, radius, excursion, support)
        return pd.DataFrame({"panel": pdf["panel"].iloc[0], "x": pdf["x"].to_numpy(), "y": y.astype(np.int32)})

    held = panels if "anchor" in panels.columns else panels.withColumns({"anchor": F.lit(False), "reference": F.lit(None).cast("int")})
    return held.select("panel", "x", "y_start", "row_center", "row_spacing", "evidence", "anchor", "reference").groupBy("panel").applyInPandas(run, "panel long, x int, y int")


def periods(df: DataFrame, by: str) -> DataFrame:
    def run(pdf):
        got = kernels.autocorrelation_period(pdf.sort_values("sample")["value"].to_numpy(float))
        return pd.DataFrame({by: [pdf[by].iloc[0]], "period": [got]}).astype({"period": float})

    return df.select(by, "sample", "value").where("value is not null").groupBy(by).applyInPandas(run, f"{by} long, period double")


def exact(df: DataFrame, by: str, step: Fraction = Fraction(1, 20)) -> DataFrame:
    """by, target, value, weight: exact rational resampling of monotone positions; df: by, position, value."""

    def run(pdf):
        pdf = pdf.sort_values("position")
        rows = kernels.exact_resample(pdf["position"].tolist(), pdf["value"].tolist(), step)
        return pd.DataFrame({by: [pdf[by].iloc[0]] * len(rows), "target": np.array([r[0] for r in rows], np.int64), "value": [r[1] for r in rows], "weight": [r[2] for r in rows]})

    return df.select(by, "position", "value").groupBy(by).applyInPandas(run, f"{by} long, target long, value double, weight double")


def series_arrays(df: DataFrame, by: str) -> DataFrame:
    """series, values in sample order; the alignment window of the policy bounds what a series should hold."""
    return df.groupBy(F.col(by).alias("series")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "value"))), lambda x: x["value"]).alias("values"))

