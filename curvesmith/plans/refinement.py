"""Queries over refined parameters, folds, stages and uneven curves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.safe import rounded as r
from ..operators import basis, gram, nonlinear, spectrum
from ..sources.tables import sales, table
from .fitting import S, rd

SQL: dict[str, str] = {}


def shipped(spark, d):
    """lineitem with an input around 0 and three planted targets, each with a little of the tax as noise."""
    x, noise = (F.col("l_quantity") - F.lit(25.0)) / F.lit(5.0), F.col("l_tax") - F.lit(0.04)
    q = F.col("l_quantity") / F.lit(10.0)
    return table(spark, d, "lineitem").select(
        "l_orderkey", q.alias("q"), x.alias("x"),
        (F.lit(1.7) * F.pow(q, F.lit(2.3)) - F.lit(0.8) * q + F.lit(3.0) + noise).alias("y_power"),
        (F.lit(1.9) * F.sin(F.lit(2.35) * x) / (x * x + F.lit(1.3)) + F.lit(0.4) * x - F.lit(0.2) + noise * F.lit(0.1)).alias("y_quotient"),
        (F.lit(2.0) * F.sin(F.lit(1.37) * x) + F.cos(F.lit(1.37) * x) + F.lit(0.5) + noise).alias("y_wave"),
    )


_rows = """SELECT l_quantity / 10.0::DOUBLE AS q, (l_quantity - 25.0::DOUBLE) / 5.0::DOUBLE AS x, l_tax - 0.04::DOUBLE AS noise FROM lineitem"""


def zoomed(moments: str, grid: list[tuple[str, float, float, float]], columns: list[str], levels: int, finer: float = 8.0) -> str:
    """SQL of a search on grids, each finer around the best place of the one before: (parameter, from, to, step) and the
    columns (two at most beside x and 1) whose least squares error is compared. `moments` has (x, n, sy, syy) a distinct x."""
    names = [g[0] for g in grid]
    k = len(columns)
    axes = [f"g{{l}}_{p} AS (SELECT unnest(generate_series(0, {{n{i}}})) * {{s{i}}}::DOUBLE + ({{o{i}}})::DOUBLE AS {p}{{frm}})" for i, p in enumerate(names)]
    parts = [f"d AS ({moments})"]
    for level in range(levels):
        for i, (_p, lo, hi, step) in enumerate(grid):
            fine = step / finer**level
            if level == 0:
                fill = {"l": 0, f"n{i}": round((hi - lo) / step), f"s{i}": repr(step), f"o{i}": repr(lo), "frm": ""}
            else:
                fill = {"l": level, f"n{i}": 24, f"s{i}": repr(fine), f"o{i}": f"(SELECT {_p} FROM b{level - 1}) - {12 * fine!r}", "frm": ""}
            parts.append(axes[i].format(**fill))
        cells = " CROSS JOIN ".join(f"g{level}_{p}" for p in names)
        cols = ", ".join(f"{c} AS u{j}" for j, c in enumerate(columns))
        pairs = ", ".join(f"sum(n * u{i} * u{j}) / sum(n) - sum(n * u{i}) / sum(n) * sum(n * u{j}) / sum(n) AS c{i}{j}" for i in range(k) for j in range(i, k))
        withx = ", ".join(f"sum(n * u{i} * x) / sum(n) - sum(n * u{i}) / sum(n) * sum(n * x) / sum(n) AS x{i}, sum(u{i} * sy) / sum(n) - sum(n * u{i}) / sum(n) * sum(sy) / sum(n) AS y{i}" for i in range(k))
        base = "sum(n * x * x) / sum(n) - pow(sum(n * x) / sum(n), 2) AS xx, sum(x * sy) / sum(n) - sum(n * x) / sum(n) * sum(sy) / sum(n) AS xy, sum(syy) / sum(n) - pow(sum(sy) / sum(n), 2) AS yy"
        key = ", ".join(names)
        free = ", ".join([*(f"c{i}{j} - x{i} * x{j} / xx AS c{i}{j}" for i in range(k) for j in range(i, k)), *(f"y{i} - x{i} * xy / xx AS y{i}" for i in range(k)), "yy - xy * xy / xx AS yy"])
        gain = "y0 * y0 / c00" if k == 1 else "(y0 * y0 * c11 - 2 * y0 * y1 * c01 + y1 * y1 * c00) / (c00 * c11 - c01 * c01)"
        parts += [
            f"m{level} AS (SELECT {key}, {pairs}, {withx}, {base} FROM (SELECT *, {cols} FROM d CROSS JOIN {cells}) GROUP BY {key})",
            f"b{level} AS (SELECT {key}, yy - {gain} AS mse FROM (SELECT {key}, {free} FROM m{level}) ORDER BY mse, {key} LIMIT 1)",
        ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT * FROM b{levels - 1}"


def _rounded(t: nonlinear.Trial, digits: int = 2) -> tuple:
    return (*[round(float(v), digits) for v in t.p], round(float(t.mse), 6))


def power_refine(spark, d):
    """The exponent of a power beside a line, from four starts: no pass gathers rows, each is one grouped sum."""
    t = nonlinear.refine_powers(shipped(spark, d), "q", "y_power", most=1)[0]
    return spark.createDataFrame([_rounded(t)], "p double, mse double")


SQL["power_refine"] = f"""
SELECT round(p, 2) AS p, round(mse, 6) AS mse FROM ({zoomed(f"SELECT q AS x, count(*)::DOUBLE AS n, sum(y) AS sy, sum(y * y) AS syy FROM (SELECT q, 1.7::DOUBLE * pow(q, 2.3) - 0.8::DOUBLE * q + 3.0::DOUBLE + noise AS y FROM ({_rows})) GROUP BY q", [("p", -1.975, 5.0, 0.05)], ["pow(x, p)"], 5)})"""


def quotient_refine(spark, d):
    """A wave over x^2 + c beside a line: frequency and offset from all starts at once."""
    t = nonlinear.refine_quotient(shipped(spark, d), "x", "y_quotient")[0]
    return spark.createDataFrame([_rounded(t)], "omega double, c double, mse double")


SQL["quotient_refine"] = f"""
SELECT round(omega, 2) AS omega, round(c, 2) AS c, round(mse, 6) AS mse FROM ({zoomed(f"SELECT x, count(*)::DOUBLE AS n, sum(y) AS sy, sum(y * y) AS syy FROM (SELECT x, 1.9::DOUBLE * sin(2.35::DOUBLE * x) / (x * x + 1.3::DOUBLE) + 0.4::DOUBLE * x - 0.2::DOUBLE + noise * 0.1::DOUBLE AS y FROM ({_rows})) GROUP BY x", [("omega", 0.1, 12.0, 0.1), ("c", 0.1, 5.0, 0.1)], ["sin(omega * x) / (x * x + c)", "cos(omega * x) / (x * x + c)"], 5, 4.0)})"""


def wave_refine(spark, d):
    """A free frequency with its sine and cosine beside a line, from several starts, over all rows."""
    done = nonlinear.refine(shipped(spark, d), "x", "y_wave", [(nonlinear.waves(1), np.array([w])) for w in (0.5, 1.0, 1.5, 2.0, 3.0)])
    t = min(done, key=lambda t: (t.mse, tuple(t.p)))
    return spark.createDataFrame([_rounded(t)], "omega double, mse double")


SQL["wave_refine"] = f"""
SELECT round(omega, 2) AS omega, round(mse, 6) AS mse FROM ({zoomed(f"SELECT x, count(*)::DOUBLE AS n, sum(y) AS sy, sum(y * y) AS syy FROM (SELECT x, 2.0::DOUBLE * sin(1.37::DOUBLE * x) + cos(1.37::DOUBLE * x) + 0.5::DOUBLE + noise AS y FROM ({_rows})) GROUP BY x", [("omega", 0.1, 12.0, 0.02)], ["sin(omega * x)", "cos(omega * x)"], 5)})"""


def fold_fits(spark, d):
    """Least squares of a constant, price and discount by the rows outside each fold, with the error inside it: the sums of
    all folds come from one pass, and a fold's complement is the total without it."""
    rows = sales(spark, d).withColumn("fold", F.pmod(F.col("l_orderkey"), F.lit(5)))
    terms = [basis.Term("1", "", F.lit(1.0)), basis.Term("x0", "", F.col("x0")), basis.Term("x1", "", F.col("x1"))]
    fits = gram.fold_fits(gram.fold_sums(basis.project(rows, terms, F.col("y"), ("fold",)), 3, "fold"), range(3))
    out = [(f, *[float(v) for v in w], mse, r2) for f, (w, mse, r2) in fits.items()]
    made = spark.createDataFrame(out, "fold long, w0 double, w1 double, w2 double, mse double, r2 double")
    return made.select("fold", *[r(F.col(c), 4).alias(c) for c in ("w0", "w1", "w2", "mse")], r(F.col("r2"), 6).alias("r2"))


#: Normal equations of what is outside each fold, centred, by hand.
SQL["fold_fits"] = f"""
WITH s AS (SELECT l_orderkey % 5 AS fold, x0 AS u, x1 AS v, y FROM ({S})), f AS (SELECT DISTINCT fold FROM s),
c AS (SELECT f.fold, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, covar_pop(u, u) AS uu, covar_pop(v, v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy
  FROM f JOIN s ON s.fold <> f.fold GROUP BY 1),
w AS (SELECT *, (uy * vv - vy * uv) / (uu * vv - uv * uv) AS w1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS w2 FROM c),
z AS (SELECT *, my - w1 * mu - w2 * mv AS w0 FROM w),
e AS (SELECT fold, w0, w1, w2, avg(pow(y - w0 - w1 * u - w2 * v, 2)) AS mse, var_pop(y) AS var FROM s JOIN z USING (fold) GROUP BY ALL)
SELECT fold, {rd('w0')} AS w0, {rd('w1')} AS w1, {rd('w2')} AS w2, {rd('mse')} AS mse, {rd('1 - mse / var', 6)} AS r2 FROM e"""


def staged_fit(spark, d):
    """The staged fit of a power beside a line: R2 of the displayed formula in each fold, and the guard over all."""
    from .staged import StagedRegressor

    m = StagedRegressor(folds=3).fit(shipped(spark, d), ["q"], "y_power", F.col("l_orderkey"))
    out = [(f["fold"], f["n"], float(f["r2"]), m.stable) for f in m.folds]
    return spark.createDataFrame(out, "fold long, n long, r2 double, stable boolean").select("fold", "n", r(F.col("r2"), 5).alias("r2"), "stable")


#: The planted target in each fold.
SQL["staged_fit"] = f"""
WITH s AS (SELECT l_orderkey % 3 AS fold, l_quantity / 10.0::DOUBLE AS q, l_tax - 0.04::DOUBLE AS noise FROM lineitem),
p AS (SELECT fold, noise, 1.7::DOUBLE * pow(q, 2.3) - 0.8::DOUBLE * q + 3.0::DOUBLE + noise AS y FROM s),
f AS (SELECT fold, count(*) AS n, 1 - avg(noise * noise) / var_pop(y) AS r2 FROM p GROUP BY 1)
SELECT fold, n, {rd('r2', 5)} AS r2, min(r2) OVER () >= 0.98 AND stddev_pop(r2) OVER () <= 0.03 AS stable FROM f"""


def uneven_frequencies(spark, d):
    """The strongest frequencies of each user's values over time (in tens of days), whose events lie unevenly."""
    e = table(spark, d, "events").select("user_id", (F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(864e9)).alias("x"), "value")
    out = spectrum.frequencies(e, ["user_id"], "x", "value", 3)
    return out.select("user_id", "n", *[r(F.get("omegas", F.lit(k)), 4).alias(f"omega{k + 1}") for k in range(3)])


#: Neighbours by as-of joins, the transform bin by bin, peaks by their neighbours, harmonics by the peaks kept so far.
SQL["uneven_frequencies"] = f"""
WITH e AS (SELECT user_id, (epoch_us(ts) - 1704067200000000) / 864e9::DOUBLE AS x, value AS y FROM events),
u AS (SELECT user_id, min(x) AS lo, max(x) AS hi, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 8 AND min(x) < max(x)),
g AS (SELECT user_id, k, CASE WHEN k = 1023 THEN hi ELSE lo + k * ((hi - lo) / 1023) END AS g, (hi - lo) / 1023 AS step FROM u, (SELECT unnest(range(1024)) AS k)),
a AS (SELECT g.*, e.x AS x0, e.y AS y0 FROM g ASOF JOIN e ON g.user_id = e.user_id AND g.g >= e.x),
b AS (SELECT a.*, e.x AS x1, e.y AS y1 FROM a ASOF JOIN e ON a.user_id = e.user_id AND a.g <= e.x),
v AS (SELECT user_id, k, step, CASE WHEN x1 = x0 THEN y0 ELSE y0 + (y1 - y0) * (g - x0) / (x1 - x0) END AS v FROM b),
h AS (SELECT user_id, k, step, (v - avg(v) OVER (PARTITION BY user_id)) * (0.5 - 0.5 * cos(2 * pi() * k / 1023)) AS v FROM v),
w AS (SELECT DISTINCT user_id, step, m, 2 * pi() * m / (4096 * step) AS w FROM (SELECT DISTINCT user_id, step FROM h), (SELECT unnest(range(2049)) AS m)),
t AS (SELECT user_id, m, w, sqrt(pow(sum(v * cos(2 * pi() * ((k * m) % 4096) / 4096)), 2) + pow(sum(v * sin(2 * pi() * ((k * m) % 4096) / 4096)), 2)) AS size
  FROM h JOIN w USING (user_id, step) WHERE w < 60 GROUP BY ALL),
p AS (SELECT *, lag(size) OVER o AS before, lead(size) OVER o AS after, max(size) OVER (PARTITION BY user_id) AS top FROM t WINDOW o AS (PARTITION BY user_id ORDER BY m)),
k AS (SELECT user_id, list([w] ORDER BY size DESC, m) AS ws FROM p WHERE size > before AND size >= after AND w > 0.1 AND w < 50 AND size > 0.1 * top GROUP BY 1),
r AS (SELECT user_id, list_reduce(list_prepend([]::DOUBLE[], ws), lambda kept, x: CASE WHEN len(kept) < 3 AND len(list_filter(kept, lambda o: round(x[1] / o) >= 2 AND abs(x[1] / o - round(x[1] / o)) <= 0.05)) = 0 THEN list_concat(kept, x) ELSE kept END) AS ws FROM k)
SELECT u.user_id, u.n, {', '.join(f"{rd(f'ws[{k}]')} AS omega{k}" for k in (1, 2, 3))} FROM u LEFT JOIN r USING (user_id)"""


QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
