"""Operator scores of curves by rule: how well each family's straightened form is a line, and how peaked the spectrum is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_corr(a: Column, b: Column) -> Column:
    """Of the rows where both are there; 0 where one doesn't vary."""
    ok = a.isNotNull() & b.isNotNull()
    x, y = F.when(ok, a), F.when(ok, b)
    n = F.count(x).cast("double")
    sx, sy, sxx, syy, sxy = F.sum(x), F.sum(y), F.sum(x * x), F.sum(y * y), F.sum(x * y)
    num, den = n * sxy - sx * sy, (n * sxx - sx * sx) * (n * syy - sy * sy)
    return F.when(den > 1e-9, num * num / F.nullif(den, F.lit(0.0))).otherwise(F.lit(0.0))


def operator_scores(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, linear, exponential, power, log): one grouped aggregate of power sums."""
    a, b = F.col(x), F.col(y)
    ln = lambda c: F.when(F.abs(c) > 1e-12, F.ln(F.abs(c)))
    return rows.groupBy(key).agg(
        squared_corr(a, b).alias("linear"), squared_corr(a, ln(b)).alias("exponential"), squared_corr(ln(a), ln(b)).alias("power"), squared_corr(ln(a), b).alias("log"),
    )


def temperature(rows: DataFrame, logit: str, label: str, grid: list[float]) -> DataFrame:
    """(temperature, nll) of sigmoid(logit / T) for every T of the grid: one aggregate."""
    z = F.col(logit)

    def nll(t: float) -> Column:
        s = z / F.lit(float(t))
        # log(1 + exp(s)) - y * s, written so that nothing overflows
        return F.avg(F.greatest(s, F.lit(0.0)) + F.ln(F.lit(1.0) + F.exp(-F.abs(s))) - F.col(label) * s)

    one = rows.agg(*[nll(t).alias(f"n{i}") for i, t in enumerate(grid)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("temperature"), F.col(f"n{i}").alias("nll")) for i, t in enumerate(grid)])).alias("t")).select("t.*")


#: Bounds of the temperature.
COLDEST, HOTTEST = 0.01, 100.0


def fit_temperature(rows: DataFrame, logit: str, label: str, rounds: int = 40, tol: float = 1e-10) -> tuple[float, float | None, int]:
    """(temperature, its mean loss, rows): the temperature of least log loss by Newton's steps on its inverse, in which the
    loss is convex. A step is one aggregate over the rows, no longer than a factor of four, and halved while it makes matters
    worse. Where all rows are on the right side of 0 the loss has no least place, and the coldest temperature is returned. Null
    or infinite logits and null labels don't count; without rows it is 1."""
    z, y = F.col(logit).cast("double"), F.col(label).cast("double")
    used = rows.filter(z.isNotNull() & ~F.isnan(z) & (F.abs(z) < float("inf")) & y.isNotNull()).select(z.alias("z"), y.alias("y"))

    def at(a: float):
        s = F.lit(a) * F.col("z")
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.least(-s, F.lit(700.0)), F.lit(-700.0))))
        loss = F.greatest(s, F.lit(0.0)) + F.log1p(F.exp(-F.abs(s))) - F.col("y") * s
        return used.agg(F.avg(loss), F.avg((p - F.col("y")) * F.col("z")), F.avg(p * (F.lit(1.0) - p) * F.col("z") * F.col("z")), F.count(F.lit(1))).first()

    a, now = 1.0, at(1.0)
    if not now[3]:
        return 1.0, None, 0
    for _ in range(rounds):
        step = -now[1] / now[2] if now[2] > 1e-300 else -now[1] * 1e300
        new, got = min(max(a + step, a / 4, 1 / HOTTEST), a * 4, 1 / COLDEST), None
        while abs(new - a) > tol * a and (got := at(new))[0] > now[0]:
            new, got = (a + new) / 2, None
        if got is None:
            break
        a, now = new, got
    return 1 / a, float(now[0]), int(now[3])
