"""Errors, residual shape, certainty and stability as aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import safe
from . import ranked


def mse(y: Column, p: Column) -> Column:
    return F.avg((p - y) * (p - y))


def r2(y: Column, p: Column) -> Column:
    """1 - SSres/SStot from power sums; 1 or 0 where y doesn't vary. Not the squared correlation."""
    res = F.sum((p - y) * (p - y))
    tot = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return F.when(tot < 1e-15, F.when(res < 1e-15, 1.0).otherwise(0.0)).otherwise(1 - res / F.nullif(tot, F.lit(0.0)))


def residual_moments(e: Column) -> dict[str, Column]:
    """Mean squared error, population skewness and excess kurtosis, from power sums (one pass, partial aggregates)."""
    n = F.count(e).cast("double")
    m1, m2, m3, m4 = (F.sum(F.pow(e, F.lit(float(k)))) / n for k in (1, 2, 3, 4))
    var = m2 - m1 * m1
    c3 = m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1
    c4 = m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1
    safe_var = F.nullif(F.greatest(var, F.lit(0.0)), F.lit(0.0))
    return {"mse": m2, "skewness": c3 / F.pow(safe_var, F.lit(1.5)), "kurtosis": c4 / (safe_var * safe_var) - 3}


def suspicious(rows: DataFrame, keys: list[str], x: str, e: str, edge: float = 0.05, tie: list[str] | None = None) -> DataFrame:
    """Per group: moments, error at the edges of x over that of the core, and whether any of them is out of bounds."""
    k = F.greatest(F.floor(F.col("_n") * F.lit(edge)), F.lit(1))
    placed = ranked.ends(rows, keys, x, tie or [x], k).withColumn("_edge", F.col("low") | F.col("high"))
    m = residual_moments(F.col(e))
    sq = F.col(e) * F.col(e)
    out = placed.groupBy(*keys).agg(
        *[c.alias(name) for name, c in m.items()],
        F.avg(F.when(F.col("_edge"), sq)).alias("edge_mse"), F.avg(F.when(~F.col("_edge"), sq)).alias("core_mse"), F.count(F.lit(1)).alias("n"),
    )
    ratio = F.col("edge_mse") / F.nullif(F.col("core_mse"), F.lit(0.0))
    bad = (F.abs("skewness") > 1) | (F.col("kurtosis") > 3) | (F.col("edge_core") > 2)
    return out.withColumn("edge_core", ratio).withColumn("suspicious", (F.col("n") >= 10) & F.coalesce(bad, F.lit(False)))


#: Fewest points of a curve whose spectrum counts, and the ratio beyond which it has structure.
LEAST_POINTS, STRUCTURED = 10, 8.0


def spectral_peaks(rows: DataFrame, keys: list[str], pos: str, e: str) -> DataFrame:
    """(keys, n, peak_ratio, structured): the highest bin of the spectrum of a curve's residuals, in order of pos, over the
    median bin. Residuals that are no finite number are left out; curves of fewer than LEAST_POINTS have none. A curve is one
    row in its task, its points put in order there."""
    ok = rows.select(*keys, F.col(pos).alias("_x"), F.col(e).cast("double").alias("_e")).filter(safe.is_finite(F.col("_e")))
    curves = ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("_x", "_e"))).alias("_p"))

    @F.arrow_udf("double")
    def ratio(values: pa.Array) -> pa.Array:
        out = []
        for v in values:
            a = np.asarray(v.values.to_numpy(zero_copy_only=False), float)
            size = np.abs(np.fft.rfft(a - a.mean())[1:]) if len(a) >= LEAST_POINTS else []
            out.append(float(np.max(size) / max(np.median(size), 1e-12)) if len(size) else None)
        return pa.array(out, pa.float64())

    out = curves.withColumn("peak_ratio", ratio(F.transform("_p", lambda p: p["_e"])))
    return out.select(*keys, "n", "peak_ratio", F.coalesce(F.col("peak_ratio") > STRUCTURED, F.lit(False)).alias("structured"))


def entropy_margin(rows: DataFrame, keys: list[str], name: str, weight: str) -> DataFrame:
    """Per group of weighted names: normalised entropy, lead of the first over the second, and uncertain."""
    w = Window.partitionBy(*keys)
    p = F.col(weight) / F.sum(weight).over(w)
    placed = rows.withColumn("_p", p).withColumn("_k", F.row_number().over(w.orderBy(F.desc(weight), F.asc(name))))
    n = F.count(F.lit(1))
    h = F.sum(-F.col("_p") * F.ln(F.col("_p") + F.lit(1e-12)))
    out = placed.groupBy(*keys).agg(
        F.when(n > 1, h / F.ln(F.nullif(n, F.lit(1)).cast("double"))).otherwise(F.lit(0.0)).alias("entropy"),
        (F.max(F.when(F.col("_k") == 1, F.col("_p"))) - F.coalesce(F.max(F.when(F.col("_k") == 2, F.col("_p"))), F.lit(0.0))).alias("margin"),
    )
    return out.withColumn("uncertain", (F.col("entropy") > 0.8) | (F.col("margin") < 0.1))


def stability(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Quartiles, their range, population deviation and the mean of the worst tenth."""
    ranks, quantiles = ranked.quantile_ranks({"q25": 0.25, "median": 0.5, "q75": 0.75})
    worst = F.greatest(F.floor(F.col("_n") / 10), F.lit(1))
    cuts = ranked.cut(ranked.at_ranks(rows, keys, value, {**ranks, "_worst": worst}).withColumn("_k", worst))
    v = F.col(value).cast("double")
    below = v < F.col("_worst")
    total = F.coalesce(F.sum(F.when(below, v)), F.lit(0.0)) + (F.first("_k") - F.count_if(below)) * F.first("_worst")
    one = ranked.joined(rows, cuts, keys).groupBy(*keys).agg(F.stddev_pop(v).alias("sd"), (total / F.first("_k")).alias("worst_tenth"))
    got = ranked.joined(cuts.withColumns(quantiles), one, keys)
    return got.select(*keys, *quantiles, (F.col("q75") - F.col("q25")).alias("iqr"), "sd", "worst_tenth")


def threshold_f1(rows: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, f1): counts for all thresholds from one pass, a column for each and count, then unpivoted."""
    t = list(enumerate(thresholds))
    on = lambda c: F.sum(F.when(c, 1).otherwise(0))
    hit = F.col(label) == 1
    one = rows.agg(*[on(hit & (F.col(score) >= x)).alias(f"tp{i}") for i, x in t], *[on(~hit & (F.col(score) >= x)).alias(f"fp{i}") for i, x in t], on(hit).alias("pos"))
    long = one.select("pos", F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, x in t])).alias("r")).select("pos", "r.*")
    fn = F.col("pos") - F.col("tp")
    f1 = 2 * F.col("tp") / F.nullif((2 * F.col("tp") + F.col("fp") + fn).cast("double"), F.lit(0.0))
    return long.select("threshold", "tp", "fp", fn.alias("fn"), F.coalesce(f1, F.lit(0.0)).alias("f1"))


def best_threshold(rows: DataFrame, keys: list[str], label: str, score: str, thresholds: list[float]) -> DataFrame:
    """(keys, threshold, f1, positive): for each class the threshold of greatest F1, the least of equals. The counts of all
    thresholds come from one grouped pass, combined before the shuffle; null scores are below every threshold. A class
    without a positive row has an F1 of 0 at the least threshold."""
    hit = F.coalesce(F.col(label) == 1, F.lit(False))
    over = [F.coalesce(F.col(score) >= F.lit(float(t)), F.lit(False)) for t in thresholds]
    one = rows.groupBy(*keys).agg(F.count_if(hit).alias("positive"), *[c for i, o in enumerate(over) for c in (F.count_if(hit & o).alias(f"_t{i}"), F.count_if(o).alias(f"_o{i}"))])
    f1 = lambda i: F.coalesce(2 * F.col(f"_t{i}") / F.nullif((F.col(f"_o{i}") + F.col("positive")).cast("double"), F.lit(0.0)), F.lit(0.0))
    best = F.array_max(F.array(*[F.struct(f1(i).alias("f1"), F.lit(-float(t)).alias("back")) for i, t in enumerate(thresholds)]))
    out = one.withColumn("_b", best)
    return out.select(*keys, (-F.col("_b.back")).alias("threshold"), F.col("_b.f1").alias("f1"), "positive")
