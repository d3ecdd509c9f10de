"""Ordered-window operators on curves: (keys, position, y)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranked


def gradient(y: Column, w) -> Column:
    """Central differences, one-sided at the ends."""
    before, after = F.lag(y).over(w), F.lead(y).over(w)
    return F.when(before.isNull(), after - y).when(after.isNull(), y - before).otherwise((after - before) / F.lit(2.0))


def derivatives(rows: DataFrame, keys: list[str], pos: str, y: str) -> DataFrame:
    """Adds d1, d2 and curvature."""
    w = Window.partitionBy(*keys).orderBy(pos)
    out = rows.withColumn("d1", gradient(F.col(y), w)).withColumn("d2", gradient(F.col("d1"), w))
    return out.withColumn("curvature", F.abs("d2") / F.pow(F.lit(1.0) + F.col("d1") * F.col("d1"), F.lit(1.5)))


def moving_average(rows: DataFrame, keys: list[str], pos: str, y: str, width: int = 7) -> DataFrame:
    """Adds `smooth`: zero-padded, so it is always divided by the width."""
    h = width // 2
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-h, h)
    return rows.withColumn("smooth", F.sum(y).over(w) / F.lit(float(width)))


def cubic_weights(width: int = 11) -> np.ndarray:
    """Row i: the weights that give a least squares cubic over `width` even places its value at place i."""
    v = np.vander(np.arange(width) - width // 2, 4).astype(float)
    return v @ np.linalg.pinv(v)


def savitzky_golay(rows: DataFrame, keys: list[str], pos: str, y: str) -> DataFrame:
    """Adds `smooth`: local cubics over 11 places; the outer five at each end lie on the cubic of the outer eleven. Curves
    of fewer places keep their values."""
    p = cubic_weights()
    whole = Window.partitionBy(*keys)
    w = whole.orderBy(pos)
    near = {o: (F.lag(y, -o) if o < 0 else F.lead(y, o)).over(w) for o in range(-10, 11)}
    from_start, from_end = F.row_number().over(w) - 1, F.count(F.lit(1)).over(whole) - F.row_number().over(w)
    cubic = lambda i: sum((F.lit(float(p[i, j])) * F.col(f"_y{j - i + 10}") for j in range(11)), F.lit(0.0))
    out = rows.withColumns({**{f"_y{o + 10}": c for o, c in near.items()}, "_a": from_start, "_b": from_end})
    v = F.when(F.col("_a") + F.col("_b") < 10, F.col(y))
    for k in range(5):
        v = v.when(F.col("_a") == k, cubic(k)).when(F.col("_b") == k, cubic(10 - k))
    return out.withColumn("smooth", v.otherwise(cubic(5))).drop("_a", "_b", *[f"_y{k}" for k in range(21)])


def shape_counts(rows: DataFrame, keys: list[str], pos: str, y: str) -> DataFrame:
    """Per curve: sign changes around its mean, and inner extrema."""
    w = Window.partitionBy(*keys)
    o = w.orderBy(pos)
    c = rows.withColumn("_c", F.signum(F.col(y) - F.avg(y).over(w)))
    step = F.signum(F.col(y) - F.lag(y).over(o))
    c = c.withColumn("_s", step).withColumn("_prev", F.lag("_c").over(o))
    c = c.withColumn("_ps", F.lag("_s").over(o))
    count = lambda x: F.count(F.when(x, 1))
    return c.groupBy(*keys).agg(count(F.col("_c") * F.col("_prev") < 0).alias("sign_changes"), count(F.col("_s") * F.col("_ps") < 0).alias("extrema"))


def dft(rows: DataFrame, keys: list[str], pos: str, y: str, bins: int = 32) -> DataFrame:
    """(keys, k, magnitude) for k < bins of Hann-windowed curves, and magnitude over the greatest of k > 0. One pass: a
    cosine and a sine sum for each k, so the curve's rows are not multiplied."""
    w = Window.partitionBy(*keys)
    at = F.row_number().over(w.orderBy(pos)) - 1
    n = F.count(F.lit(1)).over(w)
    hann = F.lit(0.5) - F.lit(0.5) * F.cos(F.lit(2 * math.pi) * F.col("_t") / F.nullif(F.col("_n") - 1, F.lit(0)))
    placed = rows.withColumns({"_t": at.cast("double"), "_n": n.cast("double")}).withColumn("_v", F.col(y) * hann)
    angle = lambda k: F.lit(2 * math.pi * k) * F.col("_t") / F.col("_n")
    sums = placed.groupBy(*keys).agg(*[F.sum(F.col("_v") * F.cos(angle(k))).alias(f"c{k}") for k in range(bins)], *[F.sum(F.col("_v") * F.sin(angle(k))).alias(f"s{k}") for k in range(bins)])
    mag = lambda k: F.sqrt(F.col(f"c{k}") * F.col(f"c{k}") + F.col(f"s{k}") * F.col(f"s{k}"))
    long = sums.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("k"), mag(k).alias("magnitude")) for k in range(bins)])).alias("r")).select(*keys, "r.*")
    top = F.max(F.when(F.col("k") > 0, F.col("magnitude"))).over(w)
    return long.withColumn("relative", F.col("magnitude") / F.nullif(top, F.lit(0.0)))


def curvature_cdf(rows: DataFrame, keys: list[str], pos: str, y: str) -> DataFrame:
    """Adds curvature and its share of the curve's total up to each place."""
    d = derivatives(rows, keys, pos, y)
    w = Window.partitionBy(*keys)
    return d.withColumn("cdf", F.sum("curvature").over(w.orderBy(pos)) / F.nullif(F.sum("curvature").over(w), F.lit(0.0)))


def islands(rows: DataFrame, keys: list[str], pos: str, value: str, least: int = 5) -> DataFrame:
    """Runs of at least `least` rows without an improvement of the running best (gaps and islands)."""
    w = Window.partitionBy(*keys).orderBy(pos)
    best = F.min(value).over(w)
    b = rows.withColumn("_best", best)
    b = b.withColumn("_new", F.when(F.lag("_best").over(w).isNull() | (F.col("_best") < F.lag("_best").over(w)), 1).otherwise(0))
    b = b.withColumn("island", F.sum("_new").over(w))
    out = b.groupBy(*keys, "island").agg(F.min(pos).alias("first"), F.max(pos).alias("last"), F.count(F.lit(1)).alias("length"), F.min("_best").alias("best"))
    return out.filter(F.col("length") >= least)


def changes(rows: DataFrame, keys: list[str], pos: str, value: str) -> DataFrame:
    """Rows whose value differs from the one before, with that one."""
    w = Window.partitionBy(*keys).orderBy(pos)
    return rows.withColumn("before", F.lag(value).over(w)).filter(F.col("before").isNotNull() & (F.col(value) != F.col("before")))


def edges(rows: DataFrame, keys: list[str], order: list[str], share: float = 0.05) -> DataFrame:
    """Adds `edge`: whether a row is among the first or last `share` of its group in the order of a number and what
    breaks its ties. Groups are not sorted, see ranked.ends()."""
    k = F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1))
    out = ranked.ends(rows, keys, order[0], order[1:] or order, k)
    return out.withColumn("edge", F.col("low") | F.col("high")).drop("low", "high")


def edges_by_distance(rows: DataFrame, columns: list[str], tie: list[str], share: float = 0.05) -> DataFrame:
    """Adds `edge` for several variables: whether a row is among the `share` that lie farthest from the mean point."""
    mean = rows.agg(*[F.avg(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    far = F.lit(0.0)
    for i, c in enumerate(columns):
        far = far + (F.col(c) - F.col(f"_m{i}")) * (F.col(c) - F.col(f"_m{i}"))
    placed = rows.crossJoin(F.broadcast(mean)).withColumn("_far", F.round(F.sqrt(far), 9)).withColumn("_all", F.lit(1))
    k = F.greatest(F.floor(F.col("_n") * F.lit(share)), F.lit(1))
    out = ranked.ends(placed, ["_all"], "_far", tie, k)
    return out.withColumn("edge", F.col("high")).drop("low", "high", "_far", "_all", *[f"_m{i}" for i in range(len(columns))])
