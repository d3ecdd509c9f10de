"""Small least squares problems for any number of curves: sums in the JVM, a batch of solutions at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe


def pure_terms(x: Column, operators: set[str]) -> dict[str, Column]:
    """The plain terms that stand for discovered operators: x and 1 always, squares and cubes for powers and products, a
    sine and a cosine for periodic ones."""
    out = {"x": x}
    if operators & {"power", "multiply"}:
        out |= {"x^2": x * x, "x^3": x * x * x}
    if "periodic" in operators:
        out |= {"sin(x)": F.sin(x), "cos(x)": F.cos(x)}
    return out | {"1": F.lit(1.0)}


def solved(g: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Solutions w of many g w = c at once by Cholesky factors of the scaled systems, and which systems have one: those whose
    columns are no combinations of each other."""
    k = g.shape[1]
    scale = np.sqrt(np.einsum("nii->ni", g))
    ok = (scale > 0).all(1)
    scale = np.where(scale > 0, scale, 1.0)
    a, b = g / (scale[:, :, None] * scale[:, None, :]), c / scale
    low = np.zeros_like(a)
    for j in range(k):  # column by column, all systems together
        d = a[:, j, j] - (low[:, j, :j] ** 2).sum(1)
        ok &= d > 1e-10
        low[:, j, j] = np.sqrt(np.where(d > 1e-10, d, 1.0))
        low[:, j + 1 :, j] = (a[:, j + 1 :, j] - np.einsum("nik,nk->ni", low[:, j + 1 :, :j], low[:, j, :j])) / low[:, j, j, None]
    z = np.zeros_like(b)
    for j in range(k):
        z[:, j] = (b[:, j] - (low[:, j, :j] * z[:, :j]).sum(1)) / low[:, j, j]
    for j in range(k - 1, -1, -1):
        z[:, j] = (z[:, j] - (low[:, j + 1 :, j] * z[:, j + 1 :]).sum(1)) / low[:, j, j]
    return z / scale, ok


def fit_each(rows: DataFrame, keys: list[str], terms: dict[str, Column], y: str, least: float = 0.0) -> DataFrame:
    """(keys, n, weights: array in the order of terms, mse, formula) of the least squares fit of every group. Groups are
    summed by partial aggregates of the products of terms (none is gathered, however large), and what is solved is a row of
    k x k sums a group, in Arrow batches. Rows with a null or no number anywhere don't count. Groups whose terms can't be told
    apart, as those of fewer rows than terms, have null weights. Weights of no more than `least` are left out of the
    formula."""
    names, k = list(terms), len(terms)
    cols = rows.select(*keys, F.col(y).cast("double").alias("_y"), *[t.cast("double").alias(f"_t{i}") for i, t in enumerate(terms.values())])
    for c in ("_y", *[f"_t{i}" for i in range(k)]):
        cols = cols.filter(safe.is_finite(F.col(c)))
    t = [F.col(f"_t{i}") for i in range(k)] + [F.col("_y")]
    sums = cols.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(t[i] * t[j]) for i in range(k + 1) for j in range(i, k + 1)]).alias("_s"))
    at = np.triu_indices(k + 1)

    @F.arrow_udf("weights array<double>, mse double")
    def solve(s: pa.Array, n: pa.Array) -> pa.Array:
        flat = s.flatten().to_numpy(zero_copy_only=False).reshape(len(s), -1)
        m = np.zeros((len(s), k + 1, k + 1))
        m[:, at[0], at[1]] = flat
        m[:, at[1], at[0]] = flat
        count = n.to_numpy(zero_copy_only=False)
        w, ok = solved(m[:, :k, :k], m[:, :k, k])
        ok &= count >= k
        left = m[:, k, k] - 2 * np.einsum("ni,ni->n", w, m[:, :k, k]) + np.einsum("ni,nij,nj->n", w, m[:, :k, :k], w)
        lists = pa.array([x.tolist() if o else None for x, o in zip(w, ok, strict=True)], pa.list_(pa.float64()))
        return pa.StructArray.from_arrays([lists, pa.array(np.maximum(left, 0) / np.maximum(count, 1), mask=~ok)], ["weights", "mse"])

    out = sums.withColumn("_w", solve("_s", "n"))
    w = F.col("_w.weights")
    shown = F.transform(F.arrays_zip(w.alias("w"), F.array(*[F.lit(x) for x in names]).alias("t")), lambda e: F.when(F.abs(e["w"]) > least, F.concat(F.format_string("%.6g*", e["w"]), e["t"])))
    return out.select(*keys, "n", w.alias("weights"), F.col("_w.mse").alias("mse"), F.when(w.isNotNull(), F.array_join(shown, " + ")).alias("formula"))
