"""Snapping numbers to named constants and whole numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Constants that fitted numbers are held against; their negatives count too.
POSITIVE = {
    "pi": math.pi, "e": math.e, "phi": (1 + math.sqrt(5)) / 2, "sqrt(2)": math.sqrt(2), "sqrt(3)": math.sqrt(3), "sqrt(5)": math.sqrt(5),
    "pi/2": math.pi / 2, "pi/3": math.pi / 3, "pi/4": math.pi / 4, "pi/6": math.pi / 6, "2*pi": 2 * math.pi,
    "log(2)": math.log(2), "log(10)": math.log(10), "log2(e)": math.log2(math.e), "log10(e)": math.log10(math.e),
    "1/pi": 1 / math.pi, "1/e": 1 / math.e, "2/pi": 2 / math.pi, "pi^2": math.pi**2, "e^2": math.e**2,
    "1/2": 0.5, "1/3": 1 / 3, "2/3": 2 / 3, "1/4": 0.25, "3/4": 0.75,
}
CONSTANTS = {**POSITIVE, **{f"-{k}": -v for k, v in POSITIVE.items()}}


def snapped(value: float, threshold: float = 0.05) -> tuple[float, str | None]:
    """A number on the driver: the nearest constant that is nearer than the threshold and its name, or itself."""
    dist = {k: abs(value - c) / max(abs(c), 1.0) for k, c in CONSTANTS.items()}
    name = min(dist, key=lambda k: (dist[k], k))
    return (CONSTANTS[name], name) if dist[name] < threshold else (value, None)


def snapped_power(p: float, tol: float = 0.05) -> float:
    """An exponent on the driver, to the nearest half or third if that is near."""
    best = min((round(p * k) / k for k in (1, 2, 3)), key=lambda c: (abs(c - p), abs(c)))
    return best if abs(best - p) < tol else p


def to_constants(rows: DataFrame, value: str, threshold: float) -> DataFrame:
    """Adds constant (the nearest one's name, if nearer than the threshold) and snapped. Distance is relative for
    constants beyond 1, and of equally near ones the first by name counts. The constants are a literal array, so each row is projected and nothing is joined."""
    v = F.col(value)
    table = F.array(*[F.struct(F.lit(k).alias("name"), F.lit(x).alias("value")) for k, x in CONSTANTS.items()])
    dist = F.transform(table, lambda c: F.struct((F.abs(v - c["value"]) / F.greatest(F.abs(c["value"]), F.lit(1.0))).alias("dist"), c["name"].alias("name")))
    near = rows.withColumn("_near", F.array_min(dist))
    ok = F.coalesce(F.col("_near.dist") < threshold, F.lit(False))
    return near.withColumn("constant", F.when(ok, F.col("_near.name"))).withColumn("snapped", ok).drop("_near")


def to_whole(v: Column, tol: float, zero: float = 1e-4) -> Column:
    return F.when(F.abs(v) <= zero, F.lit(0.0)).when(F.abs(v - F.rint(v)) <= tol, F.rint(v)).otherwise(v)
