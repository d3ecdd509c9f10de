"""Queries over scalar functions, filters and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import safe, text
from ..functions.safe import rounded as r
from ..operators import snap
from ..sources.tables import table

ROW = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
#: Formula strings that the string operators are shown on.
FORMULAS = [
    "sin(x)^2 + cos(x)^2", "2*x**2 − 3·x + 1", "exp(-x)*sin(3*x)", "log(|x|+1)/x", "x^3+x^2+x", "5.0", "a*(b+c)-d/(e+1)", "√(x)·π",
    "1e-5*x + sinh(x)", "-x + 2",
]


def _line(spark, d, **columns):
    return table(spark, d, "lineitem").select(*ROW, *[v.alias(k) for k, v in columns.items()])


def _r4(s: str) -> str:
    return f"floor(({s}) * 10000.0 + 0.5) / 10000.0"


def signed_power(spark, d):
    x = F.col("c_acctbal") / F.lit(1000.0)
    return table(spark, d, "customer").select("c_custkey", r(safe.signed_power(x, 0.5), 4).alias("root"), r(safe.signed_power(x, 2.0), 4).alias("square"), r(safe.signed_power(x, 3.0), 4).alias("cube"))


def safe_division(spark, d):
    return _line(spark, d, ratio=r(safe.safe_division(F.col("l_extendedprice"), F.col("l_quantity") - 25.0), 4))


def clamped_exp(spark, d):
    return _line(spark, d, value=r(safe.clamped_exp(F.col("l_quantity"), 0.5, -1.0), 4))


def safe_log(spark, d):
    return table(spark, d, "customer").select("c_custkey", r(safe.safe_log(F.col("c_acctbal")), 4).alias("value"))


def soft_arithmetic(spark, d):
    return _line(spark, d, value=r(safe.soft_arithmetic(F.col("l_quantity"), F.col("l_discount") + 1.0, 1.4, 0.6), 4))


def soft_aggregation(spark, d):
    return _line(spark, d, value=r(safe.soft_aggregation(F.col("l_quantity"), F.col("l_discount") * 100.0, 2.0), 4))


def int_pow(spark, d):
    return _line(spark, d, value=r(safe.int_power(F.col("l_quantity") / F.lit(10.0), 3.2), 4))


def periodic(spark, d):
    return _line(spark, d, value=r(safe.periodic(F.col("l_quantity"), 2.0, 0.5, 0.25), 4))


_w = safe.corner_weights(1.4, 0.6)
SCALAR_SQL = {
    "signed_power": f"SELECT c_custkey, {_r4('sign(x) * pow(abs(x) + 1e-10, 0.5)')} AS root, {_r4('pow(abs(x) + 1e-10, 2.0)')} AS square, {_r4('sign(x) * pow(abs(x) + 1e-10, 3.0)')} AS cube FROM (SELECT c_custkey, c_acctbal / 1000.0::DOUBLE AS x FROM customer)",
    "safe_division": f"SELECT {KEY}, {_r4('greatest(least(l_extendedprice / (abs(l_quantity - 25.0::DOUBLE) + 1e-6) * sign(l_quantity - 25.0::DOUBLE), 1e6), -1e6)')} AS ratio FROM lineitem",
    "clamped_exp": f"SELECT {KEY}, {_r4('least(exp(0.5::DOUBLE * l_quantity + (-1.0)::DOUBLE), 1e6)')} AS value FROM lineitem",
    "safe_log": f"SELECT c_custkey, {_r4('ln(abs(c_acctbal) + 1e-6)')} AS value FROM customer",
    "soft_arithmetic": f"SELECT {KEY}, {_r4(f'{_w['add']!r}::DOUBLE * (a + b) + {_w['mul']!r}::DOUBLE * (a * b) + {_w['div']!r}::DOUBLE * (a / (abs(b) + 1e-6) * sign(b)) + {_w['sub']!r}::DOUBLE * (a - b)')} AS value FROM (SELECT *, l_quantity AS a, l_discount + 1.0::DOUBLE AS b FROM lineitem)",
    "soft_aggregation": f"SELECT {KEY}, {_r4('(a * exp(a / 2.0::DOUBLE - t) + b * exp(b / 2.0::DOUBLE - t)) / (exp(a / 2.0::DOUBLE - t) + exp(b / 2.0::DOUBLE - t))')} AS value FROM (SELECT *, greatest(a / 2.0::DOUBLE, b / 2.0::DOUBLE) AS t FROM (SELECT *, l_quantity AS a, l_discount * 100.0::DOUBLE AS b FROM lineitem))",
    "int_pow": f"SELECT {KEY}, {_r4('pow(l_quantity / 10.0::DOUBLE, 3.0::DOUBLE)')} AS value FROM lineitem",
    "periodic": f"SELECT {KEY}, {_r4('2.0::DOUBLE * sin(0.5::DOUBLE * l_quantity + 0.25::DOUBLE)')} AS value FROM lineitem",
}


def constant_snap(spark, d):
    """Balances and negated prices, scaled to where the constants lie, snapped to the nearest of them."""
    c = table(spark, d, "customer").select(F.lit("customer").alias("what"), F.col("c_custkey").alias("key"), (F.col("c_acctbal") / F.lit(1000.0)).alias("v"))
    p = table(spark, d, "part").select(F.lit("part").alias("what"), F.col("p_partkey").alias("key"), (-F.col("p_retailprice") / F.lit(200.0)).alias("v"))
    return snap.to_constants(c.unionByName(p), "v", 0.05).select("what", "key", r(F.col("v"), 4).alias("v"), "constant", "snapped")


_consts = ", ".join(f"('{k}', {v!r}::DOUBLE)" for k, v in snap.CONSTANTS.items())
SCALAR_SQL["constant_snap"] = f"""
WITH c(name, value) AS (VALUES {_consts}),
l AS (SELECT 'customer' AS what, c_custkey AS key, c_acctbal / 1000.0::DOUBLE AS v FROM customer UNION ALL SELECT 'part', p_partkey, -p_retailprice / 200.0::DOUBLE FROM part),
j AS (SELECT l.*, c.name, abs(v - value) / CASE WHEN abs(value) > 1 THEN abs(value) ELSE 1.0 END AS dist FROM l, c),
m AS (SELECT what, key, v, min_by(name, (dist, name)) AS name, min(dist) AS dist FROM j GROUP BY ALL)
SELECT what, key, {_r4('v')} AS v, CASE WHEN dist < 0.05 THEN name END AS constant, dist < 0.05 AS snapped FROM m"""


def float_snap(spark, d):
    v = F.col("p_retailprice") / F.lit(100.0)
    return table(spark, d, "part").select("p_partkey", r(snap.to_whole(v, 0.05), 4).alias("value"))


SCALAR_SQL["float_snap"] = f"SELECT p_partkey, {_r4('CASE WHEN abs(v) <= 0.0001 THEN 0.0 WHEN abs(v - round_even(v, 0)) <= 0.05 THEN round_even(v, 0) ELSE v END')} AS value FROM (SELECT p_partkey, p_retailprice / 100.0::DOUBLE AS v FROM part)"


def _formulas(spark):
    return spark.createDataFrame([(i, f) for i, f in enumerate(FORMULAS)], "id int, formula string")


def formula_strings(spark, d):
    """Spelling, terms, size and tags of formula strings, one for each nation."""
    rows = table(spark, d, "nation").select("n_nationkey", (F.col("n_nationkey") % len(FORMULAS)).alias("id")).join(F.broadcast(_formulas(spark)), "id")
    n = text.normalised(F.col("formula"))
    return rows.select("n_nationkey", n.alias("ascii"), text.term_count(n).alias("n_terms"), text.model_size(n).alias("model_size"), text.operator_tags(n).alias("tags"))


def _sql_formulas() -> str:
    from ..functions.expr import SPELLINGS

    values = ", ".join(f"({i}, '{f}')" for i, f in enumerate(FORMULAS))
    norm = "formula"
    for a, b in SPELLINGS.items():
        norm = f"replace({norm}, '{a}', '{b}')"
    flat = r"regexp_replace(ascii, '\s+', '', 'g')"
    for _ in range(10):
        flat = rf"regexp_replace({flat}, '\([^()]*\)', '@', 'g')"
    tags = " ".join(f"CASE WHEN regexp_matches(ascii, '{p}') THEN '{k}' END," for k, p in {"exponential": r"exp\(|e\^", "log": r"(log|ln)\(", "periodic": r"(sin|cos|tan)\(", "power": r"\^|\*\*|sqrt\(", "rational": "/"}.items())
    return rf"""
WITH f(id, formula) AS (VALUES {values}),
n AS (SELECT n_nationkey, trim(regexp_replace({norm}, '\s+', ' ', 'g')) AS ascii FROM nation JOIN f ON n_nationkey % {len(FORMULAS)} = id),
t AS (SELECT *, regexp_replace({flat}, '[eE][+-](\d)', '\1', 'g') AS flat FROM n)
SELECT n_nationkey, ascii, (len(regexp_extract_all(flat, '[\w@.|][+-]')) + 1)::INT AS n_terms,
  (len(regexp_extract_all(ascii, '[-+*/^]')) + len(regexp_extract_all(ascii, '[a-z]+\(')) + 1)::INT AS model_size,
  array_to_string(list_filter([{tags.rstrip(',')}], lambda x: x IS NOT NULL), ',') AS tags
FROM t"""


SCALAR_SQL["formula_strings"] = _sql_formulas()


def finite_filter(spark, d):
    v = F.ln(F.nullif(F.greatest(F.col("l_discount"), F.lit(0.0)), F.lit(0.0)))
    return _line(spark, d, v=v).filter(safe.is_finite(F.col("v"))).select(*ROW, r(F.col("v"), 4).alias("v"))


SCALAR_SQL["finite_filter"] = f"SELECT {KEY}, {_r4('ln(l_discount)')} AS v FROM lineitem WHERE l_discount > 0"


def status_counts(spark, d):
    """Why values of a formula are rejected: no value, too large, or none of it."""
    x = F.col("l_quantity") - 25.0
    v = F.exp(F.least(x, F.lit(700.0))) / F.nullif(F.col("l_discount") - 0.05, F.lit(0.0))
    status = F.when(~safe.is_finite(v), "nan_or_inf").when(F.abs(v) > 1e6, "extreme").otherwise("ok")
    return _line(spark, d, status=status).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


SCALAR_SQL["status_counts"] = """
SELECT CASE WHEN v IS NULL THEN 'nan_or_inf' WHEN abs(v) > 1e6 THEN 'extreme' ELSE 'ok' END AS status, count(*) AS n
FROM (SELECT exp(l_quantity - 25.0::DOUBLE) / nullif(l_discount - 0.05::DOUBLE, 0) AS v FROM lineitem) GROUP BY 1"""


def trace_json_extract(spark, d):
    k = F.get_json_object("props", "$.k").cast("double")
    return table(spark, d, "events").select("event_id", k.alias("k")).filter(F.col("k").isNotNull())


SCALAR_SQL["trace_json_extract"] = "SELECT event_id, json_extract_string(props, '$.k')::DOUBLE AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"


def graph_eval(spark, d):
    """A graph of six nodes as one projection: inputs, a power, a product, a sine and a guarded ratio, weighted and summed."""
    x0, x1 = F.col("l_quantity") / F.lit(10.0), F.col("l_discount")
    n2 = safe.signed_power(x0, 1.5)
    n3 = safe.soft_arithmetic(x0, x1, 2.0, 1.0)
    n4 = safe.periodic(n2, 1.0, 2.0, 0.0)
    n5 = safe.safe_division(n3, x0)
    y = F.lit(0.25) + F.lit(0.5) * x0 + F.lit(-1.0) * x1 + F.lit(0.1) * n2 + F.lit(2.0) * n3 + F.lit(1.5) * n4 + F.lit(0.75) * n5
    return _line(spark, d, y=r(y, 4))


_c = safe.corner_weights(2.0, 1.0)
SCALAR_SQL["graph_eval"] = f"""
WITH a AS (SELECT {KEY}, l_quantity / 10.0::DOUBLE AS x0, l_discount AS x1 FROM lineitem),
b AS (SELECT *, sign(x0) * pow(abs(x0) + 1e-10, 1.5::DOUBLE) AS n2,
  {_c['add']!r}::DOUBLE * (x0 + x1) + {_c['mul']!r}::DOUBLE * (x0 * x1) + {_c['div']!r}::DOUBLE * (x0 / (abs(x1) + 1e-6) * sign(x1)) + {_c['sub']!r}::DOUBLE * (x0 - x1) AS n3 FROM a)
SELECT {KEY}, {_r4('0.25::DOUBLE + 0.5::DOUBLE * x0 + (-1.0)::DOUBLE * x1 + 0.1::DOUBLE * n2 + 2.0::DOUBLE * n3 + 1.5::DOUBLE * (1.0::DOUBLE * sin(2.0::DOUBLE * n2 + 0.0::DOUBLE)) + 0.75::DOUBLE * (n3 / (abs(x0) + 1e-6) * sign(x0))')} AS y FROM b"""


def prior_blend(spark, d):
    """Event types' shares, renormalised and blended with the even share by trust."""
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql.window import Window

    every = Window.partitionBy(F.lit(1))
    p = F.col("n") / F.sum("n").over(every)
    return n.select("event_type", r(F.lit(0.7) * p + F.lit(0.3) / F.count(F.lit(1)).over(every), 6).alias("prior"))


SCALAR_SQL["prior_blend"] = "WITH n AS (SELECT event_type, count(*)::DOUBLE AS n FROM events GROUP BY 1) SELECT event_type, floor((0.7::DOUBLE * (n / sum(n) OVER ()) + 0.3::DOUBLE / count(*) OVER ()) * 1000000.0 + 0.5) / 1000000.0 AS prior FROM n"


def entropy_margin(spark, d):
    from ..operators.diagnostics import entropy_margin as operator

    p = table(spark, d, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    out = operator(p, ["source"], "lang", "n")
    return out.select("source", r(F.col("entropy"), 4).alias("entropy"), r(F.col("margin"), 4).alias("margin"), "uncertain")


SCALAR_SQL["entropy_margin"] = f"""
WITH n AS (SELECT source, lang, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY source) AS p, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS k FROM n),
e AS (SELECT source, CASE WHEN count(*) > 1 THEN sum(-p * ln(p + 1e-12)) / ln(count(*)::DOUBLE) ELSE 0.0 END AS entropy, max(CASE WHEN k = 1 THEN p END) - coalesce(max(CASE WHEN k = 2 THEN p END), 0.0) AS margin FROM p GROUP BY 1)
SELECT source, {_r4('entropy')} AS entropy, {_r4('margin')} AS margin, entropy > 0.8 OR margin < 0.1 AS uncertain FROM e"""

QUERIES = {k: v for k, v in list(globals().items()) if k in SCALAR_SQL}
