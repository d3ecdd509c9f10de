"""Sufficient statistics of least squares, and the solvers that work on them.

One pass over the rows: each Arrow batch gives its part of B'B, B'y, y'y and the column sums; parts of one partition are
added in Python and those of all partitions by a grouped sum, so what reaches the driver is k x k, whatever the rows.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Gram:
    """g = B'B, c = B'y, yy = y'y over n rows; scale: the root mean square of each column, by which g and c are divided;
    sd: the population deviation of each column, 1 for constants; the scale where none is given."""

    g: np.ndarray
    c: np.ndarray
    yy: float
    n: float
    scale: np.ndarray
    sd: np.ndarray | None = None

    def mse(self, w: np.ndarray, cols=slice(None)) -> float:
        """Of scaled coefficients over some columns; cancellation can make it a little off, never negative."""
        g, c = self.g[cols][:, cols], self.c[cols]
        return max(0.0, float(self.yy - 2 * w @ c + w @ g @ w)) / max(self.n, 1)


def partial(projected: DataFrame, k: int, by: str | None = None, first: int = 0) -> DataFrame:
    """projected (b, y, ok) to (i, j, v), or with a whole-number column `by` to (fold, i, j, v): entries of [B y 1]'[B y 1],
    so that column k+1 holds the sums and the number of rows. `first`: only products with the columns from there on, as
    those of all columns before are known. Where there are columns `_n` and `_m2` a row stands for _n rows of equal B, y is
    their mean, and _m2 the sum of squares that y leaves of theirs."""
    counted = "_n" in projected.columns

    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            batch = batch.filter(pa.compute.and_(batch.column(0).is_valid(), batch.column(2)))
            if not batch.num_rows:
                continue
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float)  # the lists' own buffer
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            a = np.column_stack([flat.reshape(-1, k), y, np.ones(len(y))])
            fine = np.isfinite(a).all(1)
            a = a[fine]
            n, m2 = (batch.column(batch.num_columns - c).to_numpy(zero_copy_only=False).astype(float)[fine] for c in (2, 1)) if counted else (None, None)
            fold = None if by is None else batch.column(3).to_numpy(zero_copy_only=False)[fine]
            for f in [0] if fold is None else np.unique(fold).tolist():
                at = slice(None) if fold is None else fold == f
                own = a[at]
                got = own[:, first:k if first else None].T @ (own * n[at, None] if counted else own)
                if counted and not first:
                    got[k, k] += m2[at].sum()
                totals[f] = totals.get(f, 0.0) + got
        for f, total in totals.items():
            i, j = np.indices(total.shape).reshape(2, -1)
            # of a pair of new columns one entry is enough; one with an old column has its new column as i
            keep = (j >= i + first) | (j < first)
            i, j = i[keep], j[keep]
            got = {"i": pa.array(i + first, pa.int32()), "j": pa.array(j, pa.int32()), "v": total[i, j]}
            yield pa.RecordBatch.from_pydict(got if by is None else {"fold": pa.array(np.full(len(i), f), pa.int64()), **got})

    keys = ["i", "j"] if by is None else ["fold", "i", "j"]
    kept = ["b", "y", "ok"] if by is None else ["b", "y", "ok", F.col(by).cast("long").alias("fold")]
    parts = projected.select(*kept, *(["_n", "_m2"] if counted else [])).mapInArrow(run, ("" if by is None else "fold long, ") + "i int, j int, v double")
    return parts.groupBy(*keys).agg(F.sum("v").alias("v"))


@dataclass
class Sums:
    """[B y 1]'[B y 1] as it is, of k columns. Sums of disjoint rows add up; rows can be taken out again."""

    a: np.ndarray

    @property
    def k(self) -> int:
        return len(self.a) - 2

    @property
    def n(self) -> float:
        return float(self.a[-1, -1])

    def __add__(self, other: Sums) -> Sums:
        return Sums(self.a + other.a)

    def __sub__(self, other: Sums) -> Sums:
        return Sums(self.a - other.a)

    def columns(self, cols) -> Sums:
        """Of some columns only."""
        at = [*cols, self.k, self.k + 1]
        return Sums(self.a[np.ix_(at, at)])

    def gram(self) -> Gram:
        a, k, n = self.a, self.k, max(self.n, 1)
        scale = np.sqrt(np.diag(a)[:k] / n)
        scale[scale == 0] = 1.0
        var = np.diag(a)[:k] / n - (a[:k, k + 1] / n) ** 2
        sd = np.where(var > 1e-12 * scale**2, np.sqrt(np.maximum(var, 0.0)), 1.0)  # less is what cancellation leaves of 0
        return Gram(a[:k, :k] / np.outer(scale, scale), a[:k, k] / scale, float(a[k, k]), self.n, scale, sd)

    def mse(self, cols, weights) -> float:
        """Of given weights of some columns over these rows; no less than what cancellation leaves of 0."""
        cols, w, k = list(cols), np.asarray(weights, float), self.k
        left = self.a[k, k] - 2 * w @ self.a[cols, k] + w @ self.a[np.ix_(cols, cols)] @ w
        return max(0.0, float(left)) / max(self.n, 1)

    def variance(self) -> float:
        """Of the target."""
        n, k = max(self.n, 1), self.k
        return max(0.0, float(self.a[k, k] / n - (self.a[k, k + 1] / n) ** 2))

    def r2(self, cols, weights) -> float:
        """1 for no error and 0 for any where the target is constant."""
        v, m = self.variance(), self.mse(cols, weights)
        return 1 - m / v if v >= 1e-15 else float(m < 1e-15)


def _filled(got, size: int) -> np.ndarray:
    a = np.zeros((size, size))
    a[got["i"], got["j"]] = got["v"]
    a[got["j"], got["i"]] = got["v"]
    return a


def sums(projected: DataFrame, k: int) -> Sums:
    return Sums(_filled(partial(projected, k).toPandas(), k + 2))  # (k+2)(k+3)/2 rows


def fold_sums(projected: DataFrame, k: int, by: str) -> dict[int, Sums]:
    """The sums of each value of a whole-number column with few values, all from one pass."""
    got = partial(projected, k, by).toPandas()
    return {int(f): Sums(_filled(own, k + 2)) for f, own in got.groupby("fold")}


def bordered(projected: DataFrame, k: int, by: str, known: dict[int, Sums]) -> dict[int, Sums]:
    """The sums over k columns whose first ones are known already: only products with new columns are made and sent."""
    old = next(iter(known.values())).k
    got = partial(projected, k, by, old).toPandas()
    out = {}
    for f, s in known.items():
        at = [*range(old), k, k + 1]
        a = _filled(got[got["fold"] == f], k + 2)
        a[np.ix_(at, at)] = s.a
        out[f] = Sums(a)
    return out


def gram(projected: DataFrame, k: int) -> Gram:
    return sums(projected, k).gram()


def fold_fits(folds: dict[int, Sums], cols) -> dict[int, tuple[np.ndarray, float, float]]:
    """For each fold the weights of some columns by the rows of all other folds, and their error and R2 on its own rows."""
    total = sum(folds.values(), Sums(np.zeros_like(next(iter(folds.values())).a)))
    out = {}
    for f, own in sorted(folds.items()):
        s = (total - own).gram()
        w = ols(s, cols) / s.scale[list(cols)]
        out[f] = (w, own.mse(cols, w), own.r2(cols, w))
    return out


def ols(s: Gram, cols) -> np.ndarray:
    """Scaled coefficients; directions with no weight in the data get none."""
    cols = list(cols)
    return np.linalg.pinv(s.g[np.ix_(cols, cols)], rcond=1e-12, hermitian=True) @ s.c[cols]


def ridge(s: Gram, lam: float = 0.01) -> np.ndarray:
    """All columns penalised, the constant too, on the unscaled columns."""
    d = s.scale
    g, c = s.g * np.outer(d, d), s.c * d
    return np.linalg.solve(g + lam * np.eye(len(c)), c) * d


def lasso(s: Gram, alpha: float, rounds: int = 1000, tol: float = 1e-4) -> np.ndarray:
    """Coordinate descent on columns over their deviation, without centring; the threshold is alpha * n. Coefficients of
    the columns as they are."""
    w, k = np.zeros(len(s.c)), len(s.c)
    sd = s.scale if s.sd is None else s.sd
    t, by = alpha * s.n, s.scale / sd
    g, c = s.g * np.outer(by, by), s.c * by
    diag = np.diag(g)
    for _ in range(rounds):
        most = 0.0
        for j in range(k):
            if diag[j] <= 0:
                continue
            rho = c[j] - g[j] @ w + diag[j] * w[j]
            new = np.sign(rho) * max(abs(rho) - t, 0.0) / diag[j]
            most = max(most, abs(new - w[j]))
            w[j] = new
        if most < tol:
            break
    return w / sd


@dataclass
class Fit:
    terms: tuple[int, ...]
    weights: np.ndarray
    mse: float
    stage: str
    bic: float = 0.0


#: Errors below this share of the mean square of y are what cancellation leaves of 0, and the same to the criterion.
EXACT = 1e-12


def _fit(s: Gram, cols, stage: str) -> Fit:
    w = ols(s, cols)
    m = s.mse(w, list(cols))
    bic = s.n * np.log(max(m, EXACT * s.yy / max(s.n, 1), 1e-300)) + len(cols) * np.log(max(s.n, 2))
    return Fit(tuple(cols), w / s.scale[list(cols)], m, stage, float(bic))


#: Sets of columns solved at once.
BLOCK = 20_000


def _exact(s: Gram, sets: np.ndarray, below: float) -> np.ndarray:
    """The rows of sets (one set of columns a row) whose least squares error is below a bound; singular ones are not."""
    g, c = s.g[sets[:, :, None], sets[:, None, :]], s.c[sets]
    ok = np.linalg.det(g) != 0
    sets, g, c = sets[ok], g[ok], c[ok]
    try:
        w = np.linalg.solve(g, c[..., None])[..., 0]
    except np.linalg.LinAlgError:
        if len(sets) == 1:
            return sets[:0]
        half = len(sets) // 2
        return np.concatenate([_exact(s, sets[:half], below), _exact(s, sets[half:], below)])
    error = s.yy - 2 * (w * c).sum(1) + np.einsum("ni,nij,nj->n", w, g, w)
    return sets[np.maximum(error, 0.0) / max(s.n, 1) < below]


def exact_search(s: Gram, tol: float = 1e-6, depth: int = 3, constant: int = 0) -> list[Fit]:
    """Singles, then pairs, then triples of columns (each also with the constant) whose error falls below tol times the
    variance of y; stops at the first depth that has some. All sets are tried, in blocks: triples take time by the cube
    of the number of columns."""
    var = max(s.yy / max(s.n, 1), 1e-300)
    found: list[Fit] = []
    others = [j for j in range(len(s.c)) if j != constant]
    for d in range(1, depth + 1):
        every = itertools.combinations(others, d)
        while block := list(itertools.islice(every, BLOCK)):
            sets = np.array(block)
            for one in (sets, np.column_stack([np.full(len(sets), constant), sets])):
                found += [_fit(s, tuple(c), f"exact{d}") for c in _exact(s, one, tol * var).tolist()]
        if found:
            break
    return sorted(found, key=lambda f: (len(f.terms), f.mse, f.terms))


def lasso_path(s: Gram, alphas=(0.0, 0.001, 0.01, 0.05, 0.1, 0.2), least: float = 0.01) -> list[Fit]:
    """Supports along the path, each refitted without a penalty."""
    seen, out = set(), []
    for a in alphas:
        w = lasso(s, a)
        cols = tuple(np.flatnonzero(np.abs(w) >= least))
        if cols and cols not in seen:
            seen.add(cols)
            out.append(_fit(s, cols, f"lasso{a:g}"))
    return out


def bic_eliminate(s: Gram, fit: Fit, least: int = 1, most: int | None = None) -> Fit:
    """Drops terms one by one while that lowers n ln(mse) + k ln(n); with `most`, fits of more terms stay as they are."""
    best = _fit(s, fit.terms, fit.stage)
    if most is not None and len(best.terms) > most:
        return best
    while len(best.terms) > least:
        tries = [_fit(s, tuple(t for t in best.terms if t != d), "bic") for d in best.terms]
        one = min(tries, key=lambda f: (f.bic, f.mse, f.terms))
        if one.bic >= best.bic:
            break
        best = one
    return best


def backward_prune(s: Gram, fit: Fit, tolerance: float = 1.2, least: float = 0.05) -> Fit:
    """Drops the term whose loss costs least, refits, and goes on while the error stays within `tolerance` times the
    first one and the term carries less than `least` of the mean square of y. One term at least is left."""
    best = _fit(s, fit.terms, fit.stage)
    floor = EXACT * s.yy / max(s.n, 1)
    bound = max(best.mse, floor) * tolerance
    while len(best.terms) > 1:
        one = min((_fit(s, tuple(t for t in best.terms if t != d), "pruned") for d in best.terms), key=lambda f: (max(f.mse, floor), f.terms))
        if one.mse > bound or (one.mse - best.mse) * s.n > least * s.yy:
            break
        best = one
    return best
