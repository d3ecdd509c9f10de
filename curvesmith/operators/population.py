"""Whole populations as tables: migration, mass mutation, draws by weight, splits, and how curves depend on x. Draws come
from digests of keys, so the same rows get the same ones however they are partitioned."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import ranked
from .refine import draw


def migrated(rows: DataFrame, keys: list[str], explorer: str, fitness: str, name: str, most: int = 3) -> DataFrame:
    """The main population of each run (rows that are no explorers), with migrant: whether a copy of the run's best
    explorer took the row's place. That happens to the worst quarter, `most` at the most, if the explorer beats the
    whole main population. Copies carry the explorer's columns; less fitness is better and null is the worst."""
    others = [c for c in rows.columns if c not in (*keys, explorer, fitness, name)]
    lost = F.coalesce(F.col(fitness).cast("double"), F.lit(float("inf")))
    one = F.struct(lost.alias("f"), F.struct(name, fitness, *others).alias("r"))
    best = rows.groupBy(*keys).agg(F.min(F.when(F.col(explorer), one)).alias("_e"), F.min(F.when(~F.col(explorer), lost)).alias("_main"), F.count_if(~F.col(explorer)).alias("_n"))
    main = ranked.joined(rows.filter(~F.col(explorer)), best, keys)
    worst = F.row_number().over(Window.partitionBy(*keys).orderBy(lost.desc(), F.desc(name)))
    main = main.withColumn("migrant", F.coalesce(F.col("_e.f") < F.col("_main"), F.lit(False)) & (worst <= F.least(F.lit(most), F.floor(F.col("_n") / F.lit(4.0)))))
    take = lambda c: F.when(F.col("migrant"), F.col(f"_e.r.{c}")).otherwise(F.col(c)).alias(c)
    return main.select(*keys, *[take(c) for c in (name, fitness, *others)], "migrant")


def mass_mutation(rows: DataFrame, keys: list[str], signature: str, fitness: str, name: str, least: int = 3, seed: int = 0) -> DataFrame:
    """Adds fate to every individual: 'kept' where a run has at least `least` different signatures; else the two best
    are 'elite' and each other one is by an even draw a 'fresh' individual or a 'mutant' of the best."""
    few = rows.groupBy(*keys).agg(F.countDistinct(signature).alias("_kinds"))
    out = ranked.joined(rows, few, keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(fitness), name))
    fate = F.when(F.col("_kinds") >= least, "kept").when(place <= 2, "elite").when(draw("fate", str(seed), *map(F.col, keys), F.col(name)) < 0.5, "fresh").otherwise("mutant")
    return out.withColumn("fate", fate).drop("_kinds")


def drawn(rows: DataFrame, keys: list[str], weight: str, name: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of each group without replacement, with chances by weight: those with the least -ln(u) / weight. Rows
    without a positive weight are never drawn. Spark cuts groups to n before it shuffles them."""
    late = -F.ln(draw("draw", str(seed), *map(F.col, keys), F.col(name))) / F.nullif(F.col(weight).cast("double"), F.lit(0.0))
    order = F.row_number().over(Window.partitionBy(*keys).orderBy("_late", name))
    return rows.filter(F.col(weight) > 0).withColumn("_late", late).withColumn("place", order).filter(F.col("place") <= n).drop("_late")


def decoded(rows: DataFrame, keys: list[str], name: str, logit: str, k: int = 5) -> DataFrame:
    """(keys, name, probability, score, rank): the k likeliest of each group by the softmax of logits; score is what the
    probability lacks to 1."""
    top = rows.groupBy(*keys).agg(F.max(logit).alias("_top"))
    e = ranked.joined(rows, top, keys).withColumn("_e", F.exp(F.col(logit) - F.col("_top")))
    p = F.col("_e") / F.col("_sum")
    out = ranked.joined(e, e.groupBy(*keys).agg(F.sum("_e").alias("_sum")), keys).withColumns({"probability": p, "score": F.lit(1.0) - p})
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_e"), name))
    return out.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, name, "probability", "score", "rank")


def stratified(rows: DataFrame, labels: list[str], name: str, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds held_out: `share` of the rows of each combination of labels, rounded, by draws of their names. Strata are
    cut at a rank of their draws, not sorted."""
    out = rows.withColumn("_u", draw("split", str(seed), F.col(name)))
    k = F.floor(F.col("_n") * F.lit(share) + 0.5)
    return ranked.ends(out, labels, "_u", [name], k).withColumn("held_out", F.col("low")).drop("low", "high", "_u")


def mirrored(rows: DataFrame, terms: dict[str, Column], near: float = 0.9999) -> dict[str, str]:
    """Term to the first term that it goes with, itself if none: both constant and equal, or correlated by more than
    `near` in size. Sums of all pairs come from one aggregate of k x k numbers."""
    names = list(terms)
    mean = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(terms.values())]).first()
    off = [c - F.lit(float(mean[i] or 0.0)) for i, c in enumerate(terms.values())]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(*[F.avg(off[i] * off[j]).alias(f"v{i}_{j}") for i, j in pairs]).first()
    v = {p: got[f"v{p[0]}_{p[1]}"] for p in pairs}
    first = {}
    for j, b in enumerate(names):
        first[b] = b
        for i, a in enumerate(names[:j]):
            flat = [v[i, i] is not None and v[i, i] <= 1e-12, v[j, j] is not None and v[j, j] <= 1e-12]
            if first[a] != a or v[i, j] is None or flat[0] != flat[1]:
                continue
            if abs(mean[i] - mean[j]) < 1e-6 if flat[0] else abs(v[i, j]) > near * (v[i, i] * v[j, j]) ** 0.5:
                first[b] = a
                break
    return first


def polynomial_degree(rows: DataFrame, keys: list[str], x: str, y: str, most: int = 8, exact: float = 1e-11) -> DataFrame:
    """(keys, degree, relative_mse, polynomial): the least degree whose polynomial leaves less than `exact` of the
    variance of y, else the best one; a curve is a polynomial from degree 2 on. Polynomials of Chebyshev: a product of
    two is a mean of two others, so 2 * most + 1 sums and one with y for each degree hold all the normal equations, and a
    group is one row when it reaches Python, whatever its length. Rows with a null or a number that is not finite do not
    count; groups of fewer than most + 2 rows have degree 0 and no error."""
    fine = F.lit(True)
    for c in (x, y):
        fine = fine & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    own = rows.filter(fine).select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    span = own.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), F.avg("_y").alias("_m"))
    t = (F.lit(2.0) * F.col("_x") - F.col("_lo") - F.col("_hi")) / F.greatest(F.col("_hi") - F.col("_lo"), F.lit(1e-8))
    placed = ranked.joined(own, span, keys).withColumns({"_a": F.acos(F.greatest(F.least(t, F.lit(1.0)), F.lit(-1.0))), "_e": F.col("_y") - F.col("_m")})
    cheb = lambda k: F.cos(F.lit(float(k)) * F.col("_a"))
    sums = placed.groupBy(*keys).agg(F.array(*[F.sum(cheb(k)) for k in range(2 * most + 1)]).alias("t"), F.array(*[F.sum(cheb(k) * F.col("_e")) for k in range(most + 1)]).alias("c"), F.sum(F.col("_e") * F.col("_e")).alias("yy"), F.count(F.lit(1)).alias("n"))

    def solve(t: np.ndarray, c: np.ndarray, yy: float, n: int) -> tuple[int, float | None, bool]:
        if n < most + 2:
            return 0, None, False
        i = np.arange(most + 1)
        g = (t[np.add.outer(i, i)] + t[np.abs(np.subtract.outer(i, i))]) / 2
        var, left = max(yy / n, 1e-12), []
        for d in range(1, most + 1):
            w = np.linalg.pinv(g[: d + 1, : d + 1], rcond=1e-13, hermitian=True) @ c[: d + 1]
            left.append(max(yy - 2 * w @ c[: d + 1] + w @ g[: d + 1, : d + 1] @ w, 0.0) / n / var)
        good = [d for d, m in enumerate(left, 1) if m < exact]
        degree = good[0] if good else int(np.argmin(left)) + 1
        return degree, float(min(left)), bool(good) and degree >= 2

    def run(batches):
        for pdf in batches:
            got = [solve(np.asarray(r.t), np.asarray(r.c), r.yy, r.n) for r in pdf.itertuples()]
            yield pd.concat([pdf[keys], pd.DataFrame(got, columns=["degree", "relative_mse", "polynomial"], index=pdf.index)], axis=1)

    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, f"{kinds}, degree int, relative_mse double, polynomial boolean")
