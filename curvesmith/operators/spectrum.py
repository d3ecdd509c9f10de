"""Frequencies of curves whose points lie unevenly: resampled to an even grid, transformed, and reduced to peaks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe
from . import ranked

GRID = 1024
#: The transform is this many times as fine as the grid's own bins.
FINER = 4
#: The angular frequencies that count.
LOWEST, HIGHEST = 0.1, 50.0
#: Peaks below this share of the highest bin don't count; nor do curves of fewer points.
LEAST_SHARE, LEAST_POINTS = 0.1, 8


def on_grid(x: np.ndarray, y: np.ndarray, size: int = GRID) -> np.ndarray:
    return np.interp(np.linspace(x[0], x[-1], size), x, y)


def peaks(v: np.ndarray, step: float, top: int) -> list[float]:
    """Angular frequencies of the highest peaks of even values `step` apart, strongest first. The values lose their mean
    and fade out at both ends; a multiple of a stronger peak (within a twentieth) is its harmonic and left out. Bins are whole
    numbers, so ratios of a whole number and just a twentieth are common: they are told by the same divisions as in SQL."""
    v = (v - v.mean()) * np.hanning(len(v))
    size = np.abs(np.fft.rfft(v, FINER * len(v)))
    w = 2 * np.pi * np.arange(len(size)) / (FINER * len(v) * step)
    at = np.flatnonzero((size[1:-1] > size[:-2]) & (size[1:-1] >= size[2:])) + 1
    at = at[(w[at] > LOWEST) & (w[at] < HIGHEST) & (size[at] > LEAST_SHARE * size.max())]
    out: list[float] = []
    for p in at[np.argsort(-size[at], kind="stable")]:
        ratio = [w[p] / o for o in out]
        if all(round(r) < 2 or abs(r - round(r)) > 0.05 for r in ratio):
            out.append(float(w[p]))
        if len(out) == top:
            break
    return out


def frequencies(curves: DataFrame, keys: list[str], x: str, y: str, top: int = 3, size: int = GRID, count: Column | None = None) -> DataFrame:
    """(keys, n, omegas: array of at most `top` angular frequencies) of every curve. Of the points between two places of
    the grid only the first and the last matter to it, and they come from a grouped minimum and maximum of (x, y), combined
    before the shuffle (within partitions Spark sorts for that): a curve of any length leaves its executors as at most `size`
    cells. Points that are no finite
    numbers don't count; of points at the same x the least and the greatest y stand. count: how many points a row is, one if
    not given."""
    v = [F.col(c).cast("double") for c in (x, y)]
    count = F.lit(1) if count is None else count
    points = curves.select(*keys, v[0].alias("_x"), v[1].alias("_y"), count.cast("long").alias("_count")).filter(safe.is_finite(F.col("_x")) & safe.is_finite(F.col("_y")))
    span = points.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.sum("_count").alias("n"))
    step = (F.col("_hi") - F.col("_lo")) / F.lit(float(size - 1))
    cell = F.when(F.col("_x") >= F.col("_hi"), size - 1).otherwise(F.least(F.floor((F.col("_x") - F.col("_lo")) / step), F.lit(size - 1)))
    point = F.struct("_x", "_y")
    cells = ranked.joined(points, span.filter((F.col("_hi") > F.col("_lo")) & (F.col("n") >= LEAST_POINTS)), keys).groupBy(*keys, "n", cell.alias("_cell"))
    ends = cells.agg(F.min(point).alias("first"), F.max(point).alias("last")).groupBy(*keys, "n").agg(F.array_sort(F.collect_list(F.struct("_cell", "first", "last"))).alias("cells"))
    xs = lambda c: F.flatten(F.transform("cells", lambda e: F.array(e["first"][c], e["last"][c])))

    @F.arrow_udf("array<double>")
    def found(xs: pa.Array, ys: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(xs, ys, strict=True):
            a, b = (np.asarray(c.values.to_numpy(zero_copy_only=False), float) for c in (a, b))
            out.append(peaks(on_grid(a, b, size), float(a[-1] - a[0]) / (size - 1), top))
        return pa.array(out, pa.list_(pa.float64()))

    return ends.select(*keys, "n", found(xs("_x"), xs("_y")).alias("omegas"))


def dominant(rows: DataFrame, x: str, y: str, top: int = 3, count: Column | None = None) -> tuple[float, ...]:
    """The frequencies of all rows as one curve."""
    got = frequencies(rows, [], x, y, top, count=count).first()
    return tuple(got["omegas"]) if got else ()
