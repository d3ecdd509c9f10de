"""Refinement of constants, templates, generated formulas, noise: small numeric kernels run in grouped maps."""

from __future__ import annotations

import bisect
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe
from ..functions.expr import Node, num, show, var
from ..sources.shared import dealt
from . import diagnostics


def levenberg(f, p: np.ndarray, rounds: int = 30, damp: float = 1e-2, h: float = 1e-5) -> tuple[np.ndarray, float]:
    """Least squares of the residuals f(p) by damped Gauss-Newton steps with central differences; damping halves after a
    step that helps and doubles after one that doesn't."""
    r = f(p)
    best = float(r @ r)
    for _ in range(rounds):
        j = np.column_stack([(f(p + h * e) - f(p - h * e)) / (2 * h) for e in np.eye(len(p))])
        g, a = j.T @ r, j.T @ j
        step = np.linalg.lstsq(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g, rcond=None)[0]
        new = f(p + step)
        size = float(new @ new)
        if np.isfinite(size) and size < best:
            done = best - size < 1e-14 * max(best, 1e-300)
            p, r, best, damp = p + step, new, size, damp / 2
            if done:
                break
        else:
            damp *= 2
            if damp > 1e12:
                break
    return p, best / max(len(r), 1)


#: Numbers that a step of many curves holds at once, about.
HELD = 1 << 18


def scanned(t: np.ndarray, v: np.ndarray, most: float = 50.0, keep: int = 3) -> list[float]:
    """The frequencies up to `most` at which a sine and a cosine with an offset leave the least of a curve, from a grid as
    fine as half of what its length can tell apart (and no finer frequency than its points can show)."""
    span = float(t.max() - t.min()) if len(t) > 1 else 0.0
    if not 0 < span < math.inf:
        return []
    step = math.pi / (2 * span)
    grid = step * np.arange(1, int(min(most, math.pi * (len(t) - 1) / span) / step) + 1)
    left, block = [], max(1, HELD // len(t))
    v = v - v.mean()
    for k in range(0, len(grid), block):
        at = grid[k : k + block, None] * t
        s, c = np.sin(at), np.cos(at)
        s, c = s - s.mean(1, keepdims=True), c - c.mean(1, keepdims=True)
        ss, cc, sc, sv, cv = (s * s).sum(1), (c * c).sum(1), (s * c).sum(1), s @ v, c @ v
        det = ss * cc - sc * sc
        with np.errstate(all="ignore"):
            both = (sv * sv * cc - 2 * sv * cv * sc + cv * cv * ss) / det
            one = np.fmax(np.where(ss > 0, sv * sv / ss, 0.0), np.where(cc > 0, cv * cv / cc, 0.0))
        left.append(v @ v - np.where(det > 1e-12 * ss * cc, both, one))
    return [float(w) for w in grid[np.argsort(np.concatenate(left), kind="stable")[:keep]]] if left else []


def sines(t: np.ndarray, v: np.ndarray, there: np.ndarray, p: np.ndarray, own: np.ndarray, rounds: int = 60, damp: float = 1e-2) -> tuple[np.ndarray, np.ndarray]:
    """levenberg() for many sines at once: a row of t, v, there (whether a place holds a point), p (frequency, amplitude,
    phase, offset) and own (its curve) each. Their parameters and squared errors. What a start leaves of a curve can be
    nothing but rounding: then the curve's other starts end too."""

    def residual(q, at):
        turn = q[:, :1] * t[at] + q[:, 2:3]
        return np.where(there[at], q[:, 1:2] * np.sin(turn) + q[:, 3:] - v[at], 0.0), turn

    p, damp, at = p.copy(), np.full(len(p), damp), np.arange(len(p))
    r = residual(p, at)[0]
    best, exact = (r * r).sum(1), 1e-24 * np.where(there, v * v, 0.0).sum(1)
    for _ in range(rounds):
        r, turn = residual(p[at], at)
        on, wave = there[at].astype(float), np.cos(turn) * p[at, 1:2]
        j = np.stack([wave * t[at] * on, np.sin(turn) * on, wave * on, on], 2)
        a, g = j.transpose(0, 2, 1) @ j, (r[:, None, :] @ j)[:, 0]
        size = np.sqrt(np.maximum(np.einsum("pii->pi", a), 1e-12))
        a = a / (size[:, :, None] * size[:, None, :]) + np.maximum(damp[at], 1e-12)[:, None, None] * np.eye(4)
        new = p[at] - np.linalg.solve(a, (g / size)[..., None])[..., 0] / size
        error = residual(new, at)[0]
        error = (error * error).sum(1)
        better = np.isfinite(error) & (error < best[at])
        still = np.where(better, best[at] - error >= 1e-14 * np.maximum(best[at], 1e-300), damp[at] * 2 <= 1e12)
        p[at[better]], best[at[better]] = new[better], error[better]
        damp[at] = np.where(better, damp[at] / 2, damp[at] * 2)
        at = at[still & ~np.isin(own[at], own[at[best[at] <= exact[at]]])]
        if not len(at):
            break
    return p, best


def refine_omega(curves: DataFrame, key: str, x: str, y: str, starts: tuple[float, ...] = (0.5, 1.0, 2.0, 4.0)) -> DataFrame:
    """(key, omega, amplitude, phi, offset, mse): a sine fitted to each curve from several starts: given ones, and those
    that a scan of frequencies finds, as the error has a valley for each half wave that the curve's length tells apart. A
    curve is a group; those of like length take their steps together."""

    def fitted(ts: list[np.ndarray], vs: list[np.ndarray]) -> list[tuple]:
        begin = [[*starts, *scanned(t, v)] for t, v in zip(ts, vs, strict=True)]
        own = np.repeat(np.arange(len(ts)), [len(b) for b in begin])
        n, most = np.array([len(t) for t in ts]), max(len(t) for t in ts)
        t, v = (np.stack([np.pad(a, (0, most - len(a))) for a in every]) for every in (ts, vs))
        p = np.array([(w, vs[i].std() * 1.4 + 1e-9, 0.0, vs[i].mean()) for i, b in enumerate(begin) for w in b])
        p, error = sines(t[own], v[own], (np.arange(most) < n[:, None])[own], p, own)
        out = []
        for i in range(len(ts)):
            mine = np.flatnonzero(own == i)
            (w, a, phi, c), m = p[(k := mine[np.where(np.isnan(error[mine]), np.inf, error[mine]).argmin()])], error[k]
            out.append((abs(w), abs(a), phi, c, m / n[i]))
        return out

    def run(batches):
        for batch in batches:
            points, ends = batch.column(1).flatten(), np.cumsum(batch.column(1).value_lengths().to_numpy())[:-1]
            ts, vs = (np.split(points.field(k).to_numpy(zero_copy_only=False).astype(float), ends) for k in (0, 1))
            out: list = [None] * batch.num_rows
            order, k = sorted(range(len(out)), key=lambda i: (len(ts[i]), i), reverse=True), 0
            while k < len(order):
                block = order[k : k + max(1, HELD // (8 * len(ts[order[k]])))]
                for i, got in zip(block, fitted([ts[i] for i in block], [vs[i] for i in block]), strict=True):
                    out[i] = got
                k += len(block)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.float64()) for c in zip(*out, strict=True))], names=[key, "omega", "amplitude", "phi", "offset", "mse"])

    kind = curves.schema[key].dataType.simpleString()
    point = F.struct(F.col(x).cast("double").alias("t"), F.col(y).cast("double").alias("v"))
    whole = curves.groupBy(key).agg(F.array_sort(F.collect_list(point)).alias("points"))
    return whole.mapInArrow(run, f"{key} {kind}, omega double, amplitude double, phi double, offset double, mse double")


def templates(inputs: dict[str, Column]) -> dict[str, Column]:
    """Fixed shapes over all ordered choices of inputs: distance in the plane, the Lorentz factor, a damped cosine."""
    out = {}
    for a, x in inputs.items():
        for b, y in inputs.items():
            if a == b:
                continue
            if a < b:
                out[f"sqrt({a}^2 + {b}^2)"] = F.sqrt(x * x + y * y)
            out[f"{a}/sqrt(1 - {b}^2)"] = safe.divided(x, F.sqrt(F.greatest(F.lit(1.0) - y * y, F.lit(0.0))))
            out[f"exp(-{a})*cos({b})"] = F.exp(-F.least(x, F.lit(700.0))) * F.cos(y)
    return out


def match_templates(rows: DataFrame, inputs: dict[str, Column], y: str) -> DataFrame:
    """(template, slope, r2): each template fitted to y by one factor, all in one aggregate."""
    shapes = {k: F.when(safe.is_finite(v), v) for k, v in templates(inputs).items()}
    t = F.col(y)
    one = rows.agg(*[c for i, v in enumerate(shapes.values()) for c in (F.sum(v * v).alias(f"a{i}"), F.sum(v * t).alias(f"b{i}"), F.sum(F.when(v.isNotNull(), t * t)).alias(f"c{i}"))])
    long = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("template"), F.col(f"a{i}").alias("a"), F.col(f"b{i}").alias("b"), F.col(f"c{i}").alias("c")) for i, k in enumerate(shapes)])).alias("t")).select("t.*")
    slope = F.try_divide("b", "a")
    left = F.col("c") - slope * F.col("b")
    return long.select("template", slope.alias("slope"), (1 - F.try_divide(left, F.col("c"))).alias("r2"))


KINDS, SHARES = ("sum", "product", "quotient", "power", "function"), (0.3, 0.25, 0.1, 0.15, 0.2)
FUNCTIONS = ("sin", "cos", "exp", "log", "sqrt")
#: As Generator.choice() adds shares up: what it draws follows from one number in [0, 1), at a twentieth of its cost.
UPTO = (np.cumsum(SHARES) / np.cumsum(SHARES)[-1]).tolist()


def generated(rng: np.random.Generator, depth: int = 4) -> Node:
    """A random formula of one variable from a weighted grammar, no deeper than `depth`."""
    if depth <= 1 or rng.random() < 0.2:
        return var("x") if rng.random() < 0.7 else num(float(rng.integers(1, 6)))
    kind = KINDS[bisect.bisect_right(UPTO, rng.random())]
    sub = lambda: generated(rng, depth - 1)
    if kind == "power":
        return Node("^", (var("x"), num(float(rng.integers(2, 5)))))
    if kind == "function":
        return Node(FUNCTIONS[rng.integers(0, len(FUNCTIONS))], (sub(),))
    return Node({"sum": "+", "product": "*", "quotient": "/"}[kind], (sub(), sub()))


def formulas_for(rows: DataFrame, key: str, seed: int = 0, depth: int = 4) -> DataFrame:
    """(key, formula): a generated formula for each row; it depends on the key and the seed only, so partitions have no say. A
    null key counts as 0. Keys are a few bytes and formulas take long, so keys are dealt out to all cores first: a file of
    millions of them is one task else."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "formula": [show(generated(np.random.default_rng([seed, 0 if pd.isna(i) else int(i)]), depth)) for i in pdf[key]]})

    return dealt(rows.select(F.col(key).cast("long").alias(key))).mapInPandas(run, f"{key} bigint, formula string")


def formula_corpus(spark, n: int, seed: int = 0, depth: int = 4) -> DataFrame:
    """(id, formula): n generated formulas."""
    return formulas_for(spark.range(n), "id", seed, depth)


#: Noise profiles, and the share of curves up to and with each.
NOISE = {"clean": 0.20, "low": 0.45, "medium": 0.65, "high": 0.75, "pink": 0.85, "quantised": 0.95, "outliers": 1.0}
#: Bounds of the noise's deviation over the curve's.
STRENGTH = {"low": (0.003, 0.01), "medium": (0.01, 0.05), "high": (0.1, 0.3), "pink": (0.01, 0.05)}
OCTAVES = 6


def draw(*parts: Column | str) -> Column:
    """A number in (0, 1) from the first 52 bits of the MD5 of the parts: the same whatever the partitioning or engine."""
    words = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *[w.cast("string") for w in words]).cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def normal(*parts: Column | str) -> Column:
    return F.sqrt(F.lit(-2.0) * F.ln(draw("a", *parts))) * F.cos(F.lit(2 * math.pi) * draw("b", *parts))


def noisy(rows: DataFrame, key: str, pos: str, y: str, seed: int = 0) -> DataFrame:
    """Adds profile and `noisy`: each curve gets one noise profile by its key's digest. Draws depend on key, place and
    seed. Pink noise is a sum of white noises that hold for 1, 2, 4, ... places; quantised curves have 16 to 256 levels;
    one to five of a hundred places, but one at least, are outliers."""
    from pyspark.sql.window import Window

    k, tag = F.col(key), str(seed)
    whole = Window.partitionBy(key)
    u, v = draw("p", tag, k), F.col(y)
    pick = F.lit(None).cast("string")
    for name, upto in reversed(NOISE.items()):
        pick = F.when(u < upto, name).otherwise(pick)
    between = lambda lo, hi: F.lit(lo) + F.lit(hi - lo) * draw("s", tag, k)
    out = rows.withColumns({"profile": pick, "_k": F.row_number().over(whole.orderBy(pos)) - 1, "_n": F.count(F.lit(1)).over(whole), "_sd": F.stddev_pop(y).over(whole) + 1e-10, "_lo": F.min(y).over(whole), "_hi": F.max(y).over(whole)})
    held = [normal(tag, k, str(o), F.floor(F.col("_k") / F.lit(float(1 << o))).cast("long")) for o in range(OCTAVES)]
    out = out.withColumns({"_z": normal(tag, k, "w", F.col("_k")), "_pink": F.when(F.col("profile") == "pink", sum(held[1:], held[0]))})
    out = out.withColumns({"_psd": F.stddev_pop("_pink").over(whole) + 1e-10, "_r": F.row_number().over(whole.orderBy(draw("o", tag, k, F.col("_k")), "_k"))})
    hit = F.col("_r") <= F.greatest(F.floor(F.col("_n") * between(0.01, 0.05)), F.lit(1))
    span = F.col("_hi") - F.col("_lo") + 1e-10
    levels = F.pow(F.lit(2.0), F.floor(draw("l", tag, k) * 5) + 4)
    e = F.when(F.col("profile") == "pink", F.col("_pink") / F.col("_psd") * between(*STRENGTH["pink"]) * F.col("_sd"))
    for name in ("low", "medium", "high"):
        e = e.when(F.col("profile") == name, between(*STRENGTH[name]) * F.col("_sd") * F.col("_z"))
    e = e.when((F.col("profile") == "outliers") & hit, F.lit(3.0) * F.col("_sd") * F.col("_z")).otherwise(0.0)
    stepped = F.floor((v - F.col("_lo")) / span * levels + 0.5) / levels * span + F.col("_lo")
    out = out.withColumn("noisy", F.when(F.col("profile") == "quantised", stepped).otherwise(v + e))
    return out.drop("_k", "_n", "_sd", "_lo", "_hi", "_z", "_pink", "_psd", "_r")


def subset_by_size(rows: DataFrame, terms: dict[str, Column], y: str, slack: float = 2.0, most: int = 6) -> DataFrame:
    """(n_terms, terms, mse) of the best subset of each size, and whether it is the smallest within `slack` times the best
    error: all subsets of the `most` terms that weigh most in the fit of all, solved on one Gram matrix. The result says
    which terms those are; others are in no subset."""
    import itertools

    from . import basis, gram

    names = list(terms)
    s = gram.gram(basis.project(rows, [basis.Term(k, "", terms[k]) for k in names], F.col(y)), len(names))
    weight = np.abs(gram.ols(s, range(len(names))))
    top = sorted(sorted(range(len(names)), key=lambda k: (-weight[k], k))[:most])
    best, exact = {}, gram.EXACT * s.yy / max(s.n, 1)
    for k in range(1, len(top) + 1):
        fits = [gram._fit(s, c, "subset") for c in itertools.combinations(top, k)]
        best[k] = min(fits, key=lambda f: (max(f.mse, exact), f.terms))
    floor_ = max(min(f.mse for f in best.values()), exact)
    chosen = min(k for k, f in best.items() if f.mse <= slack * floor_)
    return rows.sparkSession.createDataFrame([(k, ",".join(names[t] for t in f.terms), float(f.mse), k == chosen) for k, f in best.items()], "n_terms int, terms string, mse double, chosen boolean")


def beam(rows: DataFrame, inputs: list[str], y: str, width: int = 4, rounds: int = 2, generations: int = 8, seed: int = 3) -> DataFrame:
    """Rounds of parallel searches, one configuration a group: the better half of the configurations goes on with new
    seeds derived from theirs; results of all rounds are ranked together."""
    from . import search, select

    spark = rows.sparkSession
    configs, out = [(i, seed + 101 * i) for i in range(width)], None
    for r in range(rounds):
        found = search.search(rows, inputs, y, spark.createDataFrame(configs, "config_id int, seed int"), generations).withColumn("round", F.lit(r))
        out = found if out is None else out.unionByName(found)
        if r < rounds - 1:
            best = select.top_k(found, ["config_id"], ["mse", "size", "formula"], 1).orderBy("mse", "config_id").limit(max(1, width // 2)).collect()
            configs = [(i, 7919 * (int(b.config_id) + 1) + 31 * i + r) for i, b in enumerate(best * 2)]
    return out


def evaluate(rows: DataFrame, formulas: dict[str, Column], y: str) -> DataFrame:
    """(formula, mse, r2) of several formulas in one aggregate."""
    one = rows.agg(*[c for i, v in enumerate(formulas.values()) for c in (diagnostics.mse(F.col(y), v).alias(f"m{i}"), diagnostics.r2(F.col(y), v).alias(f"r{i}"))])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("formula"), F.col(f"m{i}").alias("mse"), F.col(f"r{i}").alias("r2")) for i, k in enumerate(formulas)])).alias("t")).select("t.*")
