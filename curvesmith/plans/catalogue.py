"""The whole term catalogue on data, against its definition in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import rounded as r
from ..operators import basis
from ..sources.tables import table
from .fitting import rd

SQL: dict[str, str] = {}
OMEGAS = basis.dominant([3.3])
INPUTS = ("s", "v", "w")


def _rows(spark, d):
    p = table(spark, d, "part")
    return p.select((F.col("p_size") / F.lit(25.0) - 1.0).alias("s"), (F.col("p_retailprice") / F.lit(1500.0)).alias("v"), ((F.col("p_partkey") % 7) - 3.0).cast("double").alias("w"))


def basis_catalogue(spark, d):
    """Mean and mean square of every term of the catalogue over `part`, from its long form."""
    rows = _rows(spark, d)
    terms = basis.catalog({c: F.col(c) for c in INPUTS}, omegas=OMEGAS, constants=("e", "pi"), damped_ratios=True)
    long = basis.long(rows, terms, []).groupBy("term_id").agg(F.avg("value").alias("m"), F.avg(F.col("value") * F.col("value")).alias("q"))
    name, family = (F.element_at(F.array(*[F.lit(v) for v in vs]), F.col("term_id") + 1) for vs in ([t.name for t in terms], [t.family for t in terms]))
    mean = r(F.col("m") / F.greatest(F.sqrt("q"), F.lit(1e-300)), 6)
    return long.select(name.alias("term"), family.alias("family"), mean.alias("mean_over_rms"), F.format_string("%.5e", "q").cast("double").alias("mean_square"))


def _terms():
    """(name, family, SQL) of all terms, as the catalogue's definition reads."""
    out = [("1", "constant", "1.0::DOUBLE")]
    add = lambda *t: out.append(t)
    number = lambda v: f"{v:.10g}"
    for x in INPUTS:
        near, off = f"greatest(least({x}, 10.0), -10.0)", f"CASE WHEN abs({x}) >= 1e-3 THEN {x} WHEN {x} < 0 THEN -1e-3 ELSE 1e-3 END"
        grown = f"(CASE WHEN abs(exp({near}) - 1.0) >= 1e-6 THEN exp({near}) - 1.0 WHEN exp({near}) < 1.0 THEN -1e-6 ELSE 1e-6 END)"
        rest = f"greatest(1.0 - {x} * {x}, 1e-6)"
        add(x, "power", x)
        for k in range(2, 7):
            add(f"{x}^{k}", "power", f"pow({x}, {k})")
        for k in (0.5, 1.5, 2.5, 0.33, 0.67, 1.33, 2.33):
            add(f"sign({x})*abs({x})^{k}", "power", f"sign({x}) * pow(abs({x}) + 1e-15, {k})")
        for f in ("sin", "cos"):
            for w in OMEGAS:
                add(f"{f}({number(w)}*{x})", "periodic", f"{f}({w!r} * {x})")
            add(f"{f}({x}^2)", "periodic", f"{f}({x} * {x})")
            add(f"{f}(1/{x})", "periodic", f"{f}(1.0 / ({off}))")
            add(f"{x}*{f}({x})", "periodic", f"{x} * {f}({x})")
            for a in (0.2, 0.5):
                for w in OMEGAS:
                    add(f"exp(-{a:g}*abs({x}))*{f}({number(w)}*{x})", "damped", f"exp(-{a} * abs({x})) * {f}({w!r} * {x})")
            for k in (0.5, 1.0, 2.0):
                for w in OMEGAS[:4]:
                    add(f"{f}({number(w)}*{x})/({x}^2 + {k:g})", "rational", f"{f}({w!r} * {x}) / ({x} * {x} + {k})")
        for name, t in ((f"exp({x})", near), (f"exp(-{x})", f"-({near})"), (f"exp(-{x}^2)", f"-({x} * {x})"), (f"exp(e*{x})", f"exp(1.0) * {near}"), (f"exp(-e*{x})", f"-exp(1.0) * {near}"), (f"exp(pi*{x})", f"pi() * {near}"), (f"exp(-pi*{x})", f"-pi() * {near}")):
            add(name, "exp", f"exp({t})")
        for k, top in enumerate(("1", x, f"{x}^2", f"{x}^3")):
            add(f"{top}/(exp({x}) - 1)", "exp", f"pow({x}, {k}) / {grown}")
        add(f"log(abs({x})+1)", "log", f"ln(abs({x}) + 1.0)")
        add(f"log({x}^2+1)", "log", f"ln({x} * {x} + 1.0)")
        add(f"sqrt(abs({x}))", "power", f"sqrt(greatest(abs({x}), 1e-3))")
        add(f"1/abs({x})", "rational", f"1.0 / greatest(abs({x}), 1e-3)")
        add(f"1/sqrt(1 - {x}^2)", "rational", f"1.0 / sqrt({rest})")
        add(f"sqrt(1 - {x}^2)", "power", f"sqrt({rest})")
        add(f"{x}/sqrt(1 - {x}^2)", "rational", f"{x} / sqrt({rest})")
        add(f"1/(1 - {x}^2)", "rational", f"1.0 / {rest}")
        for k in (0.5, 1.0, 2.0):
            add(f"1/({x}^2 + {k:g})", "rational", f"1.0 / ({x} * {x} + {k})")
            add(f"{x}/({x}^2 + {k:g})", "rational", f"{x} / ({x} * {x} + {k})")
            add(f"1/(abs({x}) + {k:g})", "rational", f"1.0 / (abs({x}) + {k})")
    for a, b in (("s", "v"), ("s", "w"), ("v", "w")):
        add(f"{a}*{b}", "product", f"{a} * {b}")
        c = next(x for x in INPUTS if x not in (a, b))
        add(f"{a}*{b}/abs({c})", "rational", f"{a} * {b} / (abs({c}) + 1e-8)")
        add(f"{a}*{b}/{c}^2", "rational", f"{a} * {b} / ({c} * {c} + 1e-8)")
    add("s*v*w", "product", "s * v * w")
    for a in INPUTS:
        for b in INPUTS:
            if a != b:
                add(f"{a}/abs({b})", "rational", f"{a} / (abs({b}) + 1e-8)")
                add(f"{a}/{b}^2", "rational", f"{a} / ({b} * {b} + 1e-8)")
                add(f"{a}^2/abs({b})", "rational", f"{a} * {a} / (abs({b}) + 1e-8)")
                add(f"sqrt(abs({a}))/abs({b})", "rational", f"sqrt(abs({a}) + 1e-8) / (abs({b}) + 1e-8)")
                add(f"{a}/sqrt(abs({b}))", "rational", f"{a} / sqrt(abs({b}) + 1e-8)")
    return out


_t = _terms()
_cell = lambda q: f"greatest(least(({q})::DOUBLE, 1e6), -1e6)"
SQL["basis_catalogue"] = f"""
WITH p AS (SELECT p_size / 25.0::DOUBLE - 1.0::DOUBLE AS s, p_retailprice / 1500.0::DOUBLE AS v, ((p_partkey % 7) - 3.0)::DOUBLE AS w FROM part),
a AS (SELECT {', '.join(f'sum({_cell(q)}) / count(*) AS m{i}, sum({_cell(q)} * {_cell(q)}) / count(*) AS q{i}' for i, (_, _, q) in enumerate(_t))} FROM p),
l AS (SELECT unnest([{', '.join(repr(t[0]) for t in _t)}]) AS term, unnest([{', '.join(repr(t[1]) for t in _t)}]) AS family, unnest([{', '.join(f'm{i}' for i in range(len(_t)))}]) AS m, unnest([{', '.join(f'q{i}' for i in range(len(_t)))}]) AS q FROM a)
SELECT term, family, {rd('m / greatest(sqrt(q), 1e-300)', 6)} AS mean_over_rms, printf('%.5e', q)::DOUBLE AS mean_square FROM l"""

QUERIES = {"basis_catalogue": basis_catalogue}
