"""Generated samples: a formula over a grid, uniform draws, and noise."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr, safe


def linspace(spark: SparkSession, lo: float, hi: float, n: int) -> DataFrame:
    step = (hi - lo) / (n - 1) if n > 1 else 0.0
    return spark.range(n).select(F.col("id").alias("row_id"), (F.lit(float(lo)) + F.col("id") * F.lit(step)).alias("x"))


def formula_samples(spark: SparkSession, formula: str, lo: float, hi: float, n: int = 300, least: int = 10) -> DataFrame:
    """(row_id, x, y) where the formula is finite; ValueError if fewer than `least` rows are."""
    out = linspace(spark, lo, hi, n).withColumn("y", expr.to_column(expr.parse(formula), {"x": F.col("x")}, strict=True))
    out = out.filter(safe.is_finite(F.col("y")))
    if out.limit(least).count() < least:
        raise ValueError(f"{formula}: fewer than {least} finite rows")
    return out


def curve_samples(rows: DataFrame, formula: str, lo: Column, hi: Column, n: int = 300, name: str = "x") -> DataFrame:
    """The rows n times, with pos, the input and y: a curve of the formula for each row, over the row's own domain. Other
    columns of a row can stand in the formula as parameters; places where it is no finite number are left out."""
    step = (hi - lo) / F.lit(float(max(n - 1, 1)))
    out = rows.select("*", lo.cast("double").alias("_lo"), step.alias("_step"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("pos"))
    out = out.withColumn(name, F.col("_lo") + F.col("pos") * F.col("_step")).drop("_lo", "_step")
    tree = expr.parse(formula)
    out = out.withColumn("y", expr.to_column(tree, {v: F.col(v).cast("double") for v in expr.variables(tree)}, strict=True))
    return out.filter(safe.is_finite(F.col("y")))


def uniform_samples(spark: SparkSession, formula: str, ranges: dict[str, tuple[float, float]], n: int, seed: int = 0) -> DataFrame:
    """(row_id, inputs, y), inputs drawn evenly from a digest of row, input and seed, so partitioning has no say."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    for name, (lo, hi) in ranges.items():
        u = F.pmod(F.xxhash64("row_id", F.lit(f"{name}:{seed}")), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
        rows = rows.withColumn(name, F.lit(float(lo)) + u * F.lit(float(hi - lo)))
    return rows.withColumn("y", expr.to_column(expr.parse(formula), {k: F.col(k) for k in ranges}, strict=True))


def grid_samples(spark: SparkSession, formula: str, ranges: dict[str, tuple[float, float]], per_axis: int, avoid: dict[str, list[float]] | None = None, eps: float = 1e-3) -> DataFrame:
    """A mesh over all inputs without the places around `avoid`; one range of per_axis^k cells, so nothing is joined."""
    k = len(ranges)
    rows = spark.range(per_axis**k).withColumnRenamed("id", "row_id")
    for i, (name, (lo, hi)) in enumerate(ranges.items()):
        cell = F.pmod(F.floor(F.col("row_id") / F.lit(float(per_axis**i))).cast("long"), F.lit(per_axis))
        rows = rows.withColumn(name, F.lit(float(lo)) + cell * F.lit((hi - lo) / max(1, per_axis - 1)))
    for name, places in (avoid or {}).items():
        for a in places:
            rows = rows.filter(F.abs(F.col(name) - F.lit(float(a))) > eps)
    rows = rows.withColumn("y", expr.to_column(expr.parse(formula), {c: F.col(c) for c in ranges}, strict=True))
    return rows.filter(safe.is_finite(F.col("y")))


def with_noise(samples: DataFrame, snr_db: float, seed: int = 0, y: str = "y") -> DataFrame:
    """Adds Gaussian noise at a ratio of signal to noise; the draw is a digest of row_id (Box-Muller)."""
    power = samples.agg(F.avg(F.col(y) * F.col(y))).first()[0] or 0.0
    sd = math.sqrt(power / 10 ** (snr_db / 10))
    u = [(F.pmod(F.xxhash64("row_id", F.lit(f"n{k}:{seed}")), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52)) for k in (0, 1)]
    z = F.sqrt(F.lit(-2.0) * F.ln(u[0])) * F.cos(F.lit(2 * math.pi) * u[1])
    return samples.withColumn(y, F.col(y) + F.lit(sd) * z)
