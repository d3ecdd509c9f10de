"""The term catalogue and wide or long projections of it."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import safe


@dataclass(frozen=True)
class Term:
    name: str
    family: str
    column: Column


def clean(v: Column) -> Column:
    """To [-1e6, 1e6]; 0 where undefined."""
    return safe.clamp(F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)), safe.BIG)


def away_from_zero(x: Column, least: float) -> Column:
    """x, but no nearer to 0 than `least`, with its sign (0 counts as positive)."""
    return F.greatest(F.abs(x), F.lit(least)) * F.when(x < 0, -1.0).otherwise(1.0)


#: Exponents, offsets and decay rates of the catalogue.
FRACTIONS = (0.5, 1.5, 2.5, 0.33, 0.67, 1.33, 2.33)
OFFSETS = (0.5, 1.0, 2.0)
DECAYS = (0.2, 0.5)


def catalog(inputs: dict[str, Column], max_power: int = 6, omegas: tuple[float, ...] = (1.0, 2.0, 0.5), families: set[str] | None = None, constants: tuple[str, ...] = (), damped_ratios: bool = False) -> list[Term]:
    """Terms over the inputs, in a fixed order. families: keep only these (power, periodic, exp, log, rational, product,
    damped). omegas: frequencies, six at most count (see dominant()). constants: "e" and "pi" add exponentials with
    those factors. damped_ratios: also sines and cosines of the first four frequencies over x^2 + c."""
    out = [Term("1", "constant", F.lit(1.0))]
    add = lambda name, family, c: out.append(Term(name, family, clean(c)))
    omegas = tuple(omegas)[:6]
    number = lambda v: f"{v:.10g}"
    for x, c in inputs.items():
        c = c.cast("double")
        add(x, "power", c)
        for p in range(2, max_power + 1):
            add(f"{x}^{p}", "power", F.pow(c, F.lit(float(p))))
        for p in FRACTIONS:
            add(f"sign({x})*abs({x})^{p}", "power", safe.signed_power(c, p, 1e-15, None))
        for wave, f in (("sin", F.sin), ("cos", F.cos)):
            for w in omegas:
                add(f"{wave}({number(w)}*{x})", "periodic", f(F.lit(w) * c))
        near = F.greatest(F.least(c, F.lit(10.0)), F.lit(-10.0))
        add(f"exp({x})", "exp", F.exp(near))
        add(f"exp(-{x})", "exp", F.exp(-near))
        add(f"exp(-{x}^2)", "exp", F.exp(-F.least(c * c, F.lit(700.0))))
        grown = away_from_zero(F.exp(near) - F.lit(1.0), 1e-6)
        for k in range(4):
            add(f"{('1', x, f'{x}^2', f'{x}^3')[k]}/(exp({x}) - 1)", "exp", F.pow(c, F.lit(float(k))) / grown)
        for name in constants:
            factor = {"e": math.e, "pi": math.pi}[name]
            add(f"exp({name}*{x})", "exp", F.exp(F.lit(factor) * near))
            add(f"exp(-{name}*{x})", "exp", F.exp(F.lit(-factor) * near))
        add(f"log(abs({x})+1)", "log", F.ln(F.abs(c) + F.lit(1.0)))
        add(f"log({x}^2+1)", "log", F.ln(c * c + F.lit(1.0)))
        inverse = F.lit(1.0) / away_from_zero(c, 1e-3)
        for wave, f in (("sin", F.sin), ("cos", F.cos)):
            add(f"{wave}({x}^2)", "periodic", f(c * c))
            add(f"{wave}(1/{x})", "periodic", f(inverse))
        size = F.greatest(F.abs(c), F.lit(1e-3))
        add(f"sqrt(abs({x}))", "power", F.sqrt(size))
        add(f"1/abs({x})", "rational", F.lit(1.0) / size)
        rest = F.greatest(F.lit(1.0) - c * c, F.lit(1e-6))
        add(f"1/sqrt(1 - {x}^2)", "rational", F.lit(1.0) / F.sqrt(rest))
        add(f"sqrt(1 - {x}^2)", "power", F.sqrt(rest))
        add(f"{x}/sqrt(1 - {x}^2)", "rational", c / F.sqrt(rest))
        add(f"1/(1 - {x}^2)", "rational", F.lit(1.0) / rest)
        for k in OFFSETS:
            add(f"1/({x}^2 + {k:g})", "rational", F.lit(1.0) / (c * c + F.lit(k)))
            add(f"{x}/({x}^2 + {k:g})", "rational", c / (c * c + F.lit(k)))
            add(f"1/(abs({x}) + {k:g})", "rational", F.lit(1.0) / (F.abs(c) + F.lit(k)))
            for w in omegas[:4] if damped_ratios else ():
                for wave, f in (("sin", F.sin), ("cos", F.cos)):
                    add(f"{wave}({number(w)}*{x})/({x}^2 + {k:g})", "rational", f(F.lit(w) * c) / (c * c + F.lit(k)))
        add(f"{x}*sin({x})", "periodic", c * F.sin(c))
        add(f"{x}*cos({x})", "periodic", c * F.cos(c))
        for a in DECAYS:
            for w in omegas:
                for wave, f in (("sin", F.sin), ("cos", F.cos)):
                    add(f"exp(-{a:g}*abs({x}))*{wave}({number(w)}*{x})", "damped", F.exp(F.lit(-a) * F.least(F.abs(c), F.lit(3500.0))) * f(F.lit(w) * c))
    names = list(inputs)
    col = {k: v.cast("double") for k, v in inputs.items()}
    tiny = F.lit(1e-8)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            add(f"{a}*{b}", "product", col[a] * col[b])
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            for b in names[j + 1 :]:
                add(f"{a}*{names[j]}*{b}", "product", col[a] * col[names[j]] * col[b])
    for i, a in enumerate(names):
        for b in names[i + 1 :]:  # a*b is b*a, so each pair is there once
            for c in names:
                if c not in (a, b):
                    add(f"{a}*{b}/abs({c})", "rational", col[a] * col[b] / (F.abs(col[c]) + tiny))
                    add(f"{a}*{b}/{c}^2", "rational", col[a] * col[b] / (col[c] * col[c] + tiny))
    for a in names:
        for b in names:
            if a != b:
                low = F.abs(col[b]) + tiny
                add(f"{a}/abs({b})", "rational", col[a] / low)
                add(f"{a}/{b}^2", "rational", col[a] / (col[b] * col[b] + tiny))
                add(f"{a}^2/abs({b})", "rational", col[a] * col[a] / low)
                add(f"sqrt(abs({a}))/abs({b})", "rational", F.sqrt(F.abs(col[a]) + tiny) / low)
                add(f"{a}/sqrt(abs({b}))", "rational", col[a] / F.sqrt(low))
    return [t for t in out if families is None or t.family in families | {"constant"}]


def allowed(terms: list[Term], constraints: dict[str, bool]) -> list[Term]:
    """Terms whose family no constraint forbids; what is not named is allowed, and `arithmetic` stands for products."""
    return [t for t in terms if constraints.get("arithmetic" if t.family == "product" else t.family, True)]


def project(rows: DataFrame, terms: list[Term], y: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., b: array of term values, y, ok: whether y is a finite number). A higher-order function makes `ok`: with one
    in it Spark compiles a projection apart from its stage, in many small methods. A whole catalogue in one method is too
    long for the JIT and runs interpreted, several times as slow."""
    y = y.cast("double")
    ok = F.forall(F.array(y), safe.is_finite)
    return rows.select(*keep, F.array(*[t.column for t in terms]).alias("b"), y.alias("y"), ok.alias("ok"))


def long(rows: DataFrame, terms: list[Term], keys: list[str]) -> DataFrame:
    """(keys, term_id, name, value). The values of a row are one array, made apart from its stage as in project(): in one
    method with what parts them a catalogue is more than Spark can compile, and each term is interpreted. (An outer explode,
    as a plain one gets a filter that makes the array a second time.)"""
    first, *rest = [t.column for t in terms]
    apart = F.element_at(F.transform(F.array(first), lambda v: v), 1)
    values = rows.select(*keys, F.array(apart, *rest).alias("_values"))
    name = F.element_at(F.array(*[F.lit(t.name) for t in terms]), F.col("term_id") + 1)
    cells = values.select(*keys, F.posexplode_outer("_values").alias("term_id", "value"))
    return cells.select(*keys, "term_id", name.alias("name"), "value")


def waves(x: str, column: Column, omega: float) -> list[Term]:
    """Sine and cosine of a detected frequency."""
    return [Term(f"{f}({omega:.10g}*{x})", "periodic", clean(g(F.lit(float(f"{omega:.10g}")) * column.cast("double")))) for f, g in (("sin", F.sin), ("cos", F.cos))]


def dominant(omegas: list[float]) -> tuple[float, ...]:
    """Detected frequencies besides the usual ones, six at most."""
    out: list[float] = []
    for w in [*omegas, 1.0, 2.0, 0.5, math.pi, 2 * math.pi]:
        if all(abs(w - o) > 1e-3 for o in out):
            out.append(w)
    return tuple(out[:6])
