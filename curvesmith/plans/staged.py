"""A fit in stages: a small basis, the whole one, detected frequencies, refined quotients and powers; held out at the edges
of the data and in folds."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr, safe
from ..operators import basis, nonlinear, refine, spectrum
from ..operators.gram import Fit, Sums, bic_eliminate, bordered, exact_search, fold_sums, lasso_path, ols
from ..sources.shared import cut
from .estimator import formula_of

#: The guard by folds, and what a term costs a candidate within a stage and between stages.
MIN_FOLD_R2, MAX_FOLD_SD, LEAST_ROWS = 0.98, 0.03, 45
WITHIN, BETWEEN, FREE_TERMS = 0.001, 1e-4, 4
#: Triples are tried where the basis has at most this many columns; pairs always.
TRIPLES = 128


@dataclass
class Stage:
    """What a stage found; errors are shares of the target's mean square, but for mse and edge_mse."""

    stage: str
    formula: str
    mse: float
    n_terms: int
    edge_mse: float | None = None
    accepted: bool = False
    error: float = 0.0

    def score(self) -> float:
        return self.error + BETWEEN * max(0, self.n_terms - FREE_TERMS)


@dataclass
class StagedModel:
    formula: str
    inputs: list[str]
    mse: float
    stages: list[Stage]
    folds: list[dict] = field(default_factory=list)
    stable: bool = True
    reason: str = "ok"

    def column(self) -> Column:
        return expr.to_column(expr.parse(self.formula), {c: F.col(c) for c in self.inputs})


def replaces(new: Stage, best: Stage | None) -> bool:
    """A better score; and beside a fit that is good already no error five times as large, unless the new one is exact and
    crosses from more than five terms to five or fewer."""
    if best is None:
        return bool(np.isfinite(new.error))
    worse = best.error <= 1e-5 and new.error > 5 * best.error
    simpler = new.error < 1e-6 and new.n_terms <= 5 < best.n_terms
    return bool((not worse or simpler) and new.score() < best.score())


def guard(fold_r2: list[float], rows: float) -> tuple[bool, str]:
    """Whether a formula holds alike in all folds."""
    if rows < max(2 * len(fold_r2), LEAST_ROWS):
        return True, "insufficient_samples"
    if not fold_r2:
        return False, "no_valid_folds"
    ok = min(fold_r2) >= MIN_FOLD_R2 and float(np.std(fold_r2)) <= MAX_FOLD_SD
    return ok, "ok" if ok else "unstable_fold_performance"


def edge_rows(rows: DataFrame, inputs: list[str], share: float) -> Column:
    """Whether a row lies at the edge of the data: about `share` of the rows at either end of one input, or that share
    farthest from the mean of several. One pass for the means, one for a quantile sketch."""
    c = [F.col(i).cast("double") for i in inputs]
    if len(c) == 1:
        lo, hi = rows.agg(F.percentile_approx(c[0], [share, 1 - share], 10_000)).first()[0] or (0.0, 0.0)
        return (c[0] < lo) | (c[0] > hi)
    mean = rows.agg(*[F.avg(i) for i in c]).first()
    far = sum(((i - F.lit(m or 0.0)) * (i - F.lit(m or 0.0)) for i, m in zip(c, mean, strict=True)), F.lit(0.0))
    cut = rows.agg(F.percentile_approx(far, 1 - share, 10_000)).first()[0]
    return far > F.lit(cut or 0.0)


@dataclass
class Held:
    """What a fit reads of rows: (inputs, _fold, _n, _mean, _m2, _lo, _hi), a row for each value of the inputs in a fold with
    how many rows have it, their targets' mean, the squares it leaves, and the least and greatest target. All that depends on
    a row's inputs is the same for these, so no more is needed. Where inputs have few values they are counted once, combined
    before the shuffle, and stored; else a row is its own value. Rows without a finite target don't count; inputs that are no
    numbers are a value."""

    frame: DataFrame
    inputs: list[str]
    few: bool

    @classmethod
    def of(cls, rows: DataFrame, inputs: list[str], y: str) -> Held:
        own = rows.select(*inputs, "_fold", F.col(y).cast("double").alias("_y")).filter(safe.is_finite(F.col("_y")))
        if not nonlinear.few_values(own, *[F.col(c) for c in inputs]):
            return cls(own.select(*inputs, "_fold", F.lit(1.0).alias("_n"), F.col("_y").alias("_mean"), F.lit(0.0).alias("_m2"), F.col("_y").alias("_lo"), F.col("_y").alias("_hi")), inputs, False)
        n = F.count(F.lit(1)).cast("double")
        sums = [n.alias("_n"), F.avg("_y").alias("_mean"), (n * F.var_pop("_y")).alias("_m2"), F.min("_y").alias("_lo"), F.max("_y").alias("_hi")]
        return cls(cut(own.groupBy(*inputs, "_fold").agg(*sums)), inputs, True)

    @cached_property
    def moments(self) -> tuple[float, float, float]:
        """Number, mean and mean square of all targets."""
        n, s, q = self.frame.agg(F.sum("_n"), F.sum(F.col("_n") * F.col("_mean")), F.sum(F.col("_n") * F.col("_mean") * F.col("_mean") + F.col("_m2"))).first()
        return (n, s / n, q / n) if n else (0.0, 0.0, 0.0)

    def values(self) -> DataFrame:
        """As nonlinear.by_value(), of one input."""
        x, y = F.col(self.inputs[0]).cast("double"), F.col("_n") * F.col("_mean")
        return self.frame.select(x.alias("_x"), "_n", y.alias("_y"), (y * F.col("_mean") + F.col("_m2")).alias("_yy")).filter(safe.is_finite(F.col("_x")))

    @cached_property
    def omegas(self) -> tuple[float, ...]:
        """The frequencies of one input."""
        x = self.inputs[0]
        if not self.few:
            return spectrum.dominant(self.frame, x, "_mean")
        ends = F.array(F.struct(F.col("_lo").alias("y"), F.lit(1.0).alias("n")), F.struct(F.col("_hi").alias("y"), (F.col("_n") - 1).alias("n")))
        return spectrum.dominant(self.frame.select(F.col(x).alias("_input"), F.explode(ends).alias("_e")).select("_input", "_e.y", "_e.n"), "_input", "y", count=F.col("n"))


class StagedRegressor:
    """Rows belong to a fold and to the edge or the core; all passes but the first read a row a value of the inputs where
    those are few (Held). One pass a stage gives the products of the stage's new columns
    with all columns for each of these parts, beside those that earlier stages made; what fits the core is held against
    the edge. Refinement makes a pass a step. A last pass scores the displayed formulas of all stages in every fold.

    predictions: likely operators (power, periodic, exp, log, rational, ...) to how likely; those of at least 0.3 make the
    first basis. Without any it is powers and products."""

    def __init__(self, max_power: int = 3, predictions: dict[str, float] | None = None, folds: int = 3, edge: float = 0.05, expand: bool = True, constraints: dict[str, bool] | None = None):
        self.max_power, self.predictions, self.folds, self.edge, self.expand = max_power, predictions, folds, edge, expand
        self.constraints = constraints or {}

    def fit(self, rows: DataFrame, inputs: list[str], y: str, fold: Column | None = None) -> StagedModel:
        """fold: a whole number a row, taken modulo `folds`; else a digest of the row's inputs and target."""
        fold = F.xxhash64(*inputs, y) if fold is None else fold
        rows = rows.withColumn("_fold", F.pmod(fold.cast("long"), F.lit(self.folds)))
        edge = edge_rows(rows, inputs, self.edge)
        held = Held.of(rows, inputs, y)
        held.frame = held.frame.withColumn("_part", F.col("_fold") * 2 + F.coalesce(edge, F.lit(False)).cast("int"))
        found: list[Stage] = []
        best = None

        def offer(s: Stage | None) -> bool:
            nonlocal best
            if s is None:
                return False
            s.accepted = replaces(s, best)
            best = s if s.accepted else best
            found.append(s)
            return best.error < 1e-6 and best.n_terms <= FREE_TERMS

        done = len(inputs) > 1 and offer(self._template(rows, inputs, y))
        done = done or self._linear(held, inputs, offer)
        if not done and len(inputs) == 1:
            self._refined(held, inputs[0], lambda: best, offer)
        return self._scored(held, inputs, found, best)

    def _template(self, rows: DataFrame, inputs: list[str], y: str) -> Stage | None:
        """A fixed shape with a factor, if it leaves next to nothing."""
        got = refine.match_templates(rows, {c: F.col(c) for c in inputs}, y).filter("r2 > 1 - 1e-9").orderBy(F.desc("r2"), "template").first()
        return got and Stage("template", f"{got['slope']:.10g}*({got['template']})", 0.0, 1, error=max(0.0, 1 - got["r2"]))

    def _linear(self, held: Held, inputs: list[str], offer) -> bool:
        project = lambda terms: basis.project(held.frame, terms, F.col("_mean"), ("_part", "_n", "_m2"))
        likely = {"power", "product"} if self.predictions is None else {k for k, v in self.predictions.items() if v >= 0.3} | {"power"}
        every = basis.allowed(basis.catalog({c: F.col(c) for c in inputs}, self.max_power), self.constraints)
        terms = [t for t in every if t.family in likely | {"constant"}]
        parts = fold_sums(project(terms), len(terms), "_part")
        if not parts:
            return False
        if offer(self._best(terms, parts, "minimal")):
            return True
        rest = [t for t in every if t not in terms] if self.expand else []
        if rest:
            parts = bordered(project(terms + rest), len(terms) + len(rest), "_part", parts)
            terms = terms + rest
            if offer(self._best(terms, parts, "universal")):
                return True
        omegas = held.omegas if len(inputs) == 1 and self.constraints.get("periodic", True) else ()
        more = [t for w in omegas for t in basis.waves(inputs[0], F.col(inputs[0]), w) if t.name not in {o.name for o in terms}]
        if more:
            parts = bordered(project(terms + more), len(terms) + len(more), "_part", parts)
            return offer(self._best(terms + more, parts, "frequencies"))
        return False

    def _best(self, terms: list[basis.Term], parts: dict[int, Sums], stage: str) -> Stage | None:
        zero = Sums(np.zeros_like(next(iter(parts.values())).a))
        core, edge = (sum((s for p, s in parts.items() if p % 2 == side), zero) for side in (0, 1))
        if core.n < 10:
            core, edge = core + edge, zero
        total, g = core + edge, core.gram()
        scale = max(total.a[total.k, total.k] / max(total.n, 1), 1e-300)
        fits = exact_search(g, 1e-10, 3 if len(terms) <= TRIPLES else 2)
        if not fits:
            fits = [bic_eliminate(g, f) for f in lasso_path(g)] or [Fit(tuple(range(len(terms))), ols(g, range(len(terms))) / g.scale, 0.0, "ols")]
        out = []
        for f in fits[:50]:
            mse, far = total.mse(f.terms, f.weights), edge.mse(f.terms, f.weights) if edge.n else None
            score = mse / scale + WITHIN * len(f.terms)
            if far is not None and far > 5 * max(core.mse(f.terms, f.weights), 1e-12 * scale):
                score += 0.01 * far / scale  # it overfits the core
            out.append((score, mse, f.terms, Stage(stage, formula_of(terms, f, f.stage.startswith("exact"), 12), mse, len(f.terms), far, error=mse / scale)))
        return min(out, key=lambda o: o[:3])[3] if out else None

    def _refined(self, held: Held, x: str, now, offer) -> None:
        scale, values, rows, y = max(held.moments[2], 1e-300), held.values(), held.frame, "_mean"
        show = lambda t, stage: Stage(stage, t.formula(x, 1e-8), t.mse, int(np.sum(np.abs(t.weights) > 1e-8)), error=t.mse / scale)
        wavy, curved = self.constraints.get("periodic", True), self.constraints.get("power", True)
        far = lambda error: now() is None or now().error > error
        if curved and (far(5e-5) or now().n_terms > 6):
            t = nonlinear.best_of(nonlinear.refine_powers(rows, x, y, values=values), scale)
            if t is not None and offer(show(t, "powers")):
                return
        if not wavy or not far(1e-4):
            return
        omegas = held.omegas
        t = nonlinear.best_of(nonlinear.refine(rows, x, y, [(nonlinear.waves(k), np.array(omegas[:k])) for k in range(1, len(omegas) + 1)], values=values), scale)
        if t is not None and offer(show(t, "waves")):
            return
        if curved and far(1e-4):
            tried = nonlinear.refine_quotient(rows, x, y, omegas, values=values)
            if tried:
                offer(show(tried[0], "quotient"))

    def _scored(self, held: Held, inputs: list[str], found: list[Stage], best: Stage | None) -> StagedModel:
        """Errors of what is displayed, over all rows, and of the chosen formula in each fold."""
        if best is None:
            return StagedModel("0", inputs, float("nan"), [], [], False, "no_fit")
        given = {c: F.col(c) for c in inputs}
        v, n, m2 = (F.col(c) for c in ("_mean", "_n", "_m2"))
        left = [F.col(f"_e{i}") for i in range(len(found))]
        scored = held.frame.select("_fold", n, m2, (v - F.lit(held.moments[1])).alias("_off"), *[(v - expr.to_column(expr.parse(s.formula), given)).alias(f"_e{i}") for i, s in enumerate(found)])
        sums = [F.sum(F.when(safe.is_finite(e), n * e * e + m2)).alias(f"s{i}") for i, e in enumerate(left)]
        off, count = F.col("_off"), F.sum(n)  # from the mean of all, so that little of a fold's variance is lost
        spread = F.sum(n * off * off + m2) / count - F.pow(F.sum(n * off) / count, F.lit(2.0))
        got = scored.groupBy("_fold").agg(count.cast("long").alias("n"), F.greatest(spread, F.lit(0.0)).alias("v"), *sums).orderBy("_fold").collect()
        n, scale = sum(r["n"] for r in got), max(held.moments[2], 1e-300)
        for i, s in enumerate(found):
            s.mse = sum(r[f"s{i}"] or 0.0 for r in got) / max(n, 1)
            s.error = s.mse / scale
        best = None  # by what is displayed: rounded weights of terms that cancel can be worth little
        for s in found:
            s.accepted = replaces(s, best)
            best = s if s.accepted else best
        if best is None:
            return StagedModel("0", inputs, float("nan"), found, [], False, "no_fit")
        k = found.index(best)
        folds = [{"fold": r["_fold"], "n": r["n"], "mse": (r[f"s{k}"] or 0.0) / r["n"]} for r in got]
        for f, r in zip(folds, got, strict=True):
            f["r2"] = 1 - f["mse"] / r["v"] if r["v"] >= 1e-15 else float(f["mse"] < 1e-15)
        stable, reason = guard([f["r2"] for f in folds], n)
        return StagedModel(best.formula, inputs, best.mse, found, folds, stable, reason)
