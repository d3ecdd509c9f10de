"""FormulaRegressor: rows in, a short formula out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import basis, diagnostics
from ..operators.gram import Fit, bic_eliminate, exact_search, gram, lasso_path


def formula_of(terms: list[basis.Term], fit: Fit, snap: bool = True, digits: int = 6) -> str:
    out = None
    for i, w in zip(fit.terms, fit.weights, strict=True):
        t = expr.Node("*", (expr.num(float(w)), expr.parse(terms[i].name)))
        out = t if out is None else expr.Node("+", (out, t))
    tree = expr.simplified(out if out is not None else expr.num(0))
    return expr.show(expr.simplified(expr.snapped(tree, 1e-4, 1e-6)) if snap else tree, digits)


@dataclass
class FormulaModel:
    formula: str
    inputs: list[str]
    mse: float
    r2: float
    stage: str
    candidates: list[dict] = field(default_factory=list)

    def column(self) -> Column:
        return expr.to_column(expr.parse(self.formula), {c: F.col(c) for c in self.inputs})

    def transform(self, rows: DataFrame, name: str = "prediction") -> DataFrame:
        return rows.withColumn(name, self.column())

    def payload(self) -> dict:
        """The interchange form: skeletons, diagnostics and what to do next."""
        search = self.r2 < 0.999
        return {
            "schema_version": "fpip.v2", "candidate_skeletons": [{"formula": c["formula"], "mse": c["mse"]} for c in self.candidates[:5]],
            "sequence_uncertainty": {"entropy": None, "margin": None, "confident": not search}, "operator_priors": {}, "interaction_hints": {},
            "fit_diagnostics": {"mse": self.mse, "r2": self.r2, "stage": self.stage},
            "routing_signal": {"recommend_guided_evolution": search, "reason": "low_r2" if search else "fast_path_confident"},
        }


class FormulaRegressor:
    """Two passes over the rows: one for the Gram matrix of all terms, one that scores the displayed formulas of the
    best candidates, so what is reported is what is shown. Everything between works on k x k numbers."""

    def __init__(self, max_power: int = 3, families: set[str] | None = None, exact_tol: float = 1e-9, keep: int = 5):
        self.max_power, self.families, self.exact_tol, self.keep = max_power, families, exact_tol, keep

    def fit(self, rows: DataFrame, inputs: list[str], y: str) -> FormulaModel:
        terms = basis.catalog({c: F.col(c) for c in inputs}, self.max_power, families=self.families)
        s = gram(basis.project(rows, terms, F.col(y)), len(terms))
        fits = exact_search(s, self.exact_tol)
        if not fits:
            fits = [bic_eliminate(s, f) for f in lasso_path(s)]
        fits = sorted(fits, key=lambda f: (f.mse + 0.001 * len(f.terms) * max(s.yy / max(s.n, 1), 1e-300), f.terms))[: self.keep]
        shown = [(formula_of(terms, f), f) for f in fits]
        p = {f"p{i}": expr.to_column(expr.parse(t), {c: F.col(c) for c in inputs}) for i, (t, _) in enumerate(shown)}
        scored = rows.select(y, *[c.alias(k) for k, c in p.items()])
        got = scored.agg(*[diagnostics.mse(F.col(y), F.col(k)).alias(f"m_{k}") for k in p], *[diagnostics.r2(F.col(y), F.col(k)).alias(f"r_{k}") for k in p]).first()
        found = [{"formula": t, "mse": got[f"m_p{i}"], "r2": got[f"r_p{i}"], "n_terms": len(f.terms), "stage": f.stage} for i, (t, f) in enumerate(shown)]
        found.sort(key=lambda c: (round(c["mse"], 12), c["n_terms"], c["formula"]))
        found = [c for i, c in enumerate(found) if c["formula"] not in {o["formula"] for o in found[:i]}]
        best = found[0]
        return FormulaModel(best["formula"], inputs, best["mse"], best["r2"], best["stage"], found)
