"""Least squares by variable projection over rows that stay on executors.

A shape is a sum of columns that depend on an input and on a few parameters; only these are searched, as the columns'
weights follow from them. For given parameters, all that a Gauss-Newton step needs are inner products of the columns, of
their derivatives and of the target. So each step of all starts together is one pass over the rows, one grouped sum, and a
few numbers a start on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe
from ..sources.shared import cut

#: (columns, derivatives): arrays of a batch, a list of columns and a list of (column, parameter, its derivative).
Columns = tuple[list[np.ndarray], list[tuple[int, int, np.ndarray]]]


@dataclass(frozen=True)
class Shape:
    """names: of its parameters; low, high: their bounds; columns: from an input and parameters; terms: a formula for each
    column, from parameters; usable: the rows that count."""

    names: tuple[str, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    columns: Callable[[np.ndarray, np.ndarray], Columns]
    terms: Callable[[np.ndarray, str], list[str]]
    usable: Callable[[np.ndarray], np.ndarray] = np.isfinite


def powers(n: int, omegas: tuple[float, ...] = ()) -> Shape:
    """1, x, n powers |x|^p with p from -2 to 5, and a sine and cosine of each given frequency. A power is even in x where p
    is an even whole number, odd where it is an odd one, and a blend of both between. Rows at x = 0 don't count."""

    def columns(x: np.ndarray, p: np.ndarray) -> Columns:
        size, sign = np.abs(x) + 1e-10, np.sign(x)
        log = np.log(size)
        cols, slopes = [np.ones_like(x), x], []
        for k in range(n):
            v = size ** p[k]
            even = 0.5 * (1 + math.cos(math.pi * p[k]))
            turn = -0.5 * math.pi * math.sin(math.pi * p[k])
            slopes.append((len(cols), k, (even + (1 - even) * sign) * v * log + turn * (1 - sign) * v))
            cols.append((even + (1 - even) * sign) * v)
        for w in omegas:
            cols += [np.sin(w * x), np.cos(w * x)]
        return cols, slopes

    def terms(p: np.ndarray, x: str) -> list[str]:
        odd = [abs(q - round(q)) > 1e-9 or round(q) % 2 for q in p]
        shown = [f"sign({x})*abs({x})^{q:.6g}" if o else f"{x}^{q:.6g}" for q, o in zip(p, odd, strict=True)]
        return ["1", x, *shown, *[f"{f}({w:.6g}*{x})" for w in omegas for f in ("sin", "cos")]]

    return Shape(tuple(f"p{k + 1}" for k in range(n)), (-2.0,) * n, (5.0,) * n, columns, terms, lambda x: np.isfinite(x) & (np.abs(x) > 1e-8))


def periodic_rational() -> Shape:
    """sin(w x) and cos(w x) over x^2 + c, x and 1; c stays positive."""

    def columns(x: np.ndarray, p: np.ndarray) -> Columns:
        w, c = p
        s, k, low = np.sin(w * x), np.cos(w * x), 1.0 / (x * x + c)
        cols = [s * low, k * low, x, np.ones_like(x)]
        return cols, [(0, 0, x * k * low), (1, 0, -x * s * low), (0, 1, -s * low * low), (1, 1, -k * low * low)]

    def terms(p: np.ndarray, x: str) -> list[str]:
        return [f"sin({p[0]:.6g}*{x})/({x}^2 + {p[1]:.6g})", f"cos({p[0]:.6g}*{x})/({x}^2 + {p[1]:.6g})", x, "1"]

    return Shape(("omega", "c"), (0.01, 1e-3), (50.0, 100.0), columns, terms)


def waves(n: int) -> Shape:
    """n sines and cosines of free frequencies, x and 1."""

    def columns(x: np.ndarray, p: np.ndarray) -> Columns:
        cols, slopes = [np.ones_like(x), x], []
        for k in range(n):
            s, c = np.sin(p[k] * x), np.cos(p[k] * x)
            slopes += [(len(cols), k, x * c), (len(cols) + 1, k, -x * s)]
            cols += [s, c]
        return cols, slopes

    return Shape(tuple(f"omega{k + 1}" for k in range(n)), (0.01,) * n, (100.0,) * n, columns, lambda p, x: ["1", x, *[f"{f}({w:.6g}*{x})" for w in p for f in ("sin", "cos")]])


@dataclass(frozen=True)
class Trial:
    """Parameters of a shape and what they leave: weights of its columns and the mean square error over n rows."""

    shape: Shape
    p: np.ndarray
    weights: np.ndarray
    mse: float
    n: int
    steps: int = 0

    def formula(self, x: str, least: float = 0.0) -> str:
        return " + ".join(f"{w:.10g}*{t}" for w, t in zip(self.weights, self.shape.terms(self.p, x), strict=True) if abs(w) > least) or "0"


#: An input of at most so many different values is held as a row for each.
VALUES = 100_000


def few_values(rows: DataFrame, *inputs: Column) -> bool:
    """Whether rows have at most about VALUES different values of the inputs together."""
    return rows.agg(F.approx_count_distinct(F.struct(*inputs))).first()[0] <= VALUES


def by_value(rows: DataFrame, x: str, y: str) -> DataFrame:
    """(_x, _n, _y, _yy): how many rows have a value of the input, the sum of their targets and of their squares. Inner
    products with functions of the input need no more of rows that share a value. Where an input has few values, they are
    counted once, combined before the shuffle, and stored; else a row is its own value and nothing is shuffled. Rows whose
    input or target is no finite number don't count."""
    own = rows.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_t")).filter(safe.is_finite(F.col("_x")) & safe.is_finite(F.col("_t")))
    if not few_values(own, F.col("_x")):
        return own.select("_x", F.lit(1.0).alias("_n"), F.col("_t").alias("_y"), (F.col("_t") * F.col("_t")).alias("_yy"))
    return cut(own.groupBy("_x").agg(F.count(F.lit(1)).cast("double").alias("_n"), F.sum("_t").alias("_y"), F.sum(F.col("_t") * F.col("_t")).alias("_yy")))


def inner_products(values: DataFrame, trials: list[tuple[Shape, np.ndarray]]) -> list[np.ndarray]:
    """For each trial the inner products of its columns, derivatives and the target, from by_value(); the last column counts
    rows."""

    def run(batches):
        total: list = [0.0] * len(trials)
        for batch in batches:
            a, n, y, yy = (batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(4))
            for t, (shape, p) in enumerate(trials):
                ok = shape.usable(a)
                cols, slopes = shape.columns(a[ok], p)
                z = np.column_stack([*cols, *[s for _, _, s in slopes], np.ones(int(ok.sum()))])
                m, by = (z * n[ok, None]).T @ z, z.T @ y[ok]  # the target's place is before the last
                m = np.insert(np.insert(m, -1, by, 0), -1, np.insert(by, -1, yy[ok].sum()), 1)
                total[t] = total[t] + m
        for t, m in enumerate(total):
            if isinstance(m, np.ndarray):
                i, j = np.triu_indices(len(m))
                yield pa.RecordBatch.from_pydict({"t": pa.array(np.full(len(i), t), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": m[i, j]})

    parts = values.mapInArrow(run, "t int, i int, j int, v double")
    got = parts.groupBy("t", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = []
    for t in range(len(trials)):
        own = got[got["t"] == t]
        k = int(own["j"].max()) + 1 if len(own) else 0
        m = np.zeros((k, k))
        m[own["i"], own["j"]] = own["v"]
        out.append(np.triu(m) + np.triu(m, 1).T)
    return out


def _solved(shape: Shape, p: np.ndarray, m: np.ndarray) -> tuple[Trial, np.ndarray, np.ndarray] | None:
    """The trial, and of its residuals' derivatives J'J and J'r (the weights follow the parameters: what the columns span
    is projected out of the derivatives)."""
    cols, slopes = shape.columns(np.ones(1), p)
    k, d = len(cols), len(p)
    if len(m) < k + len(slopes) + 2 or m[-1, -1] < k + d:
        return None
    scale = np.sqrt(np.maximum(np.diag(m), 1e-300))
    m, n = m / np.outer(scale, scale), m[-1, -1]
    y = k + len(slopes)
    back = np.linalg.pinv(m[:k, :k], rcond=1e-13, hermitian=True)
    c = back @ m[:k, y]
    pick = np.zeros((len(slopes), d))  # the derivative of the fitted values by each parameter, out of those of the columns
    for s, (j, q, _) in enumerate(slopes):
        pick[s, q] = c[j] / scale[j] * scale[k + s]
    dd, pd, dy = m[k:y, k:y], m[:k, k:y], m[k:y, y]
    jj = pick.T @ (dd - pd.T @ back @ pd) @ pick
    jr = pick.T @ (dy - pd.T @ c)
    size = scale[y]
    left = max(0.0, float(1 - 2 * c @ m[:k, y] + c @ m[:k, :k] @ c)) * size**2
    return Trial(shape, p, c * size / scale[:k], left / n, int(n)), jj, jr


#: After this many steps only so many starts go on: those of the least error, but the best of each number of parameters.
SIFT, LEFT = 8, 5


def refine(rows: DataFrame, x: str, y: str, starts: list[tuple[Shape, np.ndarray]], rounds: int = 40, tol: float = 1e-9, values: DataFrame | None = None) -> list[Trial]:
    """Damped Gauss-Newton steps from every start, each step of all starts one pass over the rows. A step that doesn't
    help is taken back and tried again shorter; a start is done when its parameters stand still or its error is rounding.
    Rows whose input is no usable number, or whose target is none, don't count; with fewer rows than unknowns a start has
    no result. A pass reads a row a value of the input where those are few (by_value). values: those, where they are known."""
    values = by_value(rows, x, y) if values is None else values
    held: list = [None] * len(starts)
    damp = np.full(len(starts), 1e-3)
    tries = {i: np.clip(np.asarray(p, float), s.low, s.high) for i, (s, p) in enumerate(starts)}
    for step in range(rounds):
        if step == SIFT:
            order = sorted(tries, key=lambda i: (held[i][0].mse if held[i] else math.inf, i))
            first = {len(tries[i]): i for i in reversed(order)}
            tries = {i: tries[i] for i in {*order[:LEFT], *first.values()}}
        who = sorted(tries)
        if not who:
            break
        found = inner_products(values, [(starts[i][0], tries[i]) for i in who])
        for i, m in zip(who, found, strict=True):
            shape = starts[i][0]
            new, old = _solved(shape, tries.pop(i), m), held[i]
            if new is None:
                continue
            exact = 1e-13 * m[-2, -2] / max(m[-1, -1], 1)
            if old is None or new[0].mse < old[0].mse:
                gain = np.inf if old is None else old[0].mse - new[0].mse
                held[i] = (replace(new[0], steps=step), *new[1:])
                damp[i] = damp[i] / 4 if old is not None else damp[i]
                if new[0].mse <= exact or gain <= tol * new[0].mse:
                    continue
            else:
                damp[i] *= 8
                if damp[i] > 1e8:
                    continue
            trial, jj, jr = held[i]
            by = damp[i] * np.diag(np.maximum(np.diag(jj), 1e-12 * max(float(np.trace(jj)), 1e-300)))
            p = np.clip(trial.p + np.linalg.lstsq(jj + by, jr, rcond=None)[0], shape.low, shape.high)
            if np.max(np.abs(p - trial.p) / (1 + np.abs(trial.p)), initial=0.0) > tol:
                tries[i] = p
    return [h[0] for h in held if h is not None]


#: Where powers start.
POWER_STARTS = (0.5, 1.5, 2.5, 3.5)
#: Where frequencies and offsets of quotients start, beside detected frequencies.
OMEGA_STARTS, OFFSET_STARTS = (1.0, 2.0, 3.0, 5.0, 10.0), (0.5, 1.0, 2.0, 3.0)
#: What a term more must gain, as a share of the target's mean square.
PER_TERM = 1e-4


def best_of(trials: list[Trial], yy: float) -> Trial | None:
    """The least error, where each column costs PER_TERM of the target's mean square."""
    return min(trials, key=lambda t: (t.mse / max(yy, 1e-300) + PER_TERM * len(t.weights), t.mse, tuple(t.p)), default=None)


def refine_powers(rows: DataFrame, x: str, y: str, starts: tuple[float, ...] = POWER_STARTS, omegas: tuple[float, ...] = (), most: int = 3, values: DataFrame | None = None) -> list[Trial]:
    """One to `most` neighbouring starts at a time, refined together. The best of each number of powers, fewest first."""
    begin = [(powers(n, omegas), np.array(starts[i : i + n])) for n in range(1, min(most, len(starts)) + 1) for i in range(len(starts) - n + 1)]
    best: dict[int, Trial] = {}
    for t in refine(rows, x, y, begin, values=values):
        if len(t.p) not in best or t.mse < best[len(t.p)].mse:
            best[len(t.p)] = t
    return [best[k] for k in sorted(best)]


def omega_starts(detected: tuple[float, ...] = ()) -> list[float]:
    out: list[float] = []
    for w in (*detected, *OMEGA_STARTS):
        if 0.1 < w < 20 and all(abs(w - o) > 0.05 for o in out):
            out.append(w)
    return out


def refine_quotient(rows: DataFrame, x: str, y: str, detected: tuple[float, ...] = (), offsets: tuple[float, ...] = OFFSET_STARTS, values: DataFrame | None = None) -> list[Trial]:
    """All pairs of a frequency and an offset to start from, refined; least error first."""
    shape = periodic_rational()
    done = refine(rows, x, y, [(shape, np.array([w, c])) for w in omega_starts(detected) for c in offsets], values=values)
    return sorted(done, key=lambda t: (t.mse, tuple(t.p)))


def mean_square(rows: DataFrame, y: str | Column) -> float:
    v = F.col(y) if isinstance(y, str) else y
    return float(rows.agg(F.avg(v * v)).first()[0] or 0.0)
