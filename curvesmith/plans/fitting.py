"""Queries over fits, errors, certainty and calibration."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import rounded as r
from ..operators import basis, calibrate, diagnostics, gram
from ..sources.tables import sales, table

SQL: dict[str, str] = {}
S = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_extendedprice / 1000.0::DOUBLE AS x0, l_discount AS x1, l_quantity / 10.0::DOUBLE AS x2, l_extendedprice / 1000.0::DOUBLE - l_extendedprice / 1000.0::DOUBLE * l_discount AS y FROM lineitem"


def rd(s: str, d: int = 4) -> str:
    return f"floor(({s}) * {10**d}.0 + 0.5) / {10**d}.0"


def _part_terms():
    c = {"s": F.col("p_size") / F.lit(10.0), "v": F.col("p_retailprice") / F.lit(1000.0)}
    return [basis.Term(n, "", e.cast("double")) for n, e in (("1", F.lit(1.0)), ("s", c["s"]), ("v", c["v"]), ("s*v", c["s"] * c["v"]), ("s^2", c["s"] * c["s"]), ("v^2", c["v"] * c["v"]))]


def basis_gram(spark, d):
    """The Gram matrix of six terms of `part`, long form, from one pass of partial products."""
    terms = _part_terms()
    rows = basis.project(table(spark, d, "part"), terms, F.col("p_size") * F.col("p_retailprice") / F.lit(10000.0))
    g = gram.partial(rows, len(terms))
    return g.filter(f"j <= {len(terms)}").select("i", "j", r(F.col("v"), 3).alias("g"))


SQL["basis_gram"] = f"""
WITH t AS (SELECT p_partkey, unnest([1.0::DOUBLE, s, v, s * v, s * s, v * v, p_size * p_retailprice / 10000.0::DOUBLE]) AS b, unnest([0,1,2,3,4,5,6]) AS k
  FROM (SELECT *, p_size / 10.0::DOUBLE AS s, p_retailprice / 1000.0::DOUBLE AS v FROM part))
SELECT a.k::INT AS i, b.k::INT AS j, {rd('sum(a.b * b.b)', 3)} AS g FROM t a JOIN t b ON a.p_partkey = b.p_partkey AND a.k <= b.k GROUP BY 1, 2"""


def basis_long(spark, d):
    return basis.long(table(spark, d, "part"), _part_terms(), ["p_partkey"]).select("p_partkey", "term_id", "name", r(F.col("value"), 6).alias("value"))


SQL["basis_long"] = f"""
SELECT p_partkey, unnest([0,1,2,3,4,5])::INT AS term_id, unnest(['1','s','v','s*v','s^2','v^2']) AS name,
  unnest([{', '.join(rd(x, 6) for x in ('1.0::DOUBLE', 's', 'v', 's * v', 's * s', 'v * v'))}]) AS value
FROM (SELECT *, p_size / 10.0::DOUBLE AS s, p_retailprice / 1000.0::DOUBLE AS v FROM part)"""


def affine_fit_rank(spark, d):
    """Single terms fitted to the planted target by slope and intercept, ranked by error: all terms in one aggregate."""
    s = sales(spark, d)
    terms = {"x0": F.col("x0"), "x1": F.col("x1"), "x2": F.col("x2"), "x0*x1": F.col("x0") * F.col("x1"), "x0*x2": F.col("x0") * F.col("x2"), "x0^2": F.col("x0") * F.col("x0")}
    y, n = F.col("y"), F.count(F.lit(1)).cast("double")
    one = s.agg(n.alias("n"), F.sum("y").alias("sy"), F.sum(y * y).alias("syy"), *[x for i, t in enumerate(terms.values()) for x in (F.sum(t).alias(f"a{i}"), F.sum(t * t).alias(f"b{i}"), F.sum(t * y).alias(f"c{i}"))])
    long = one.select("n", "sy", "syy", F.explode(F.array(*[F.struct(F.lit(k).alias("term"), F.col(f"a{i}").alias("st"), F.col(f"b{i}").alias("stt"), F.col(f"c{i}").alias("sty")) for i, k in enumerate(terms)])).alias("t")).select("n", "sy", "syy", "t.*")
    det = F.col("n") * F.col("stt") - F.col("st") * F.col("st")
    slope = (F.col("n") * F.col("sty") - F.col("st") * F.col("sy")) / F.nullif(det, F.lit(0.0))
    out = long.withColumn("slope", slope).withColumn("intercept", (F.col("sy") - F.col("slope") * F.col("st")) / F.col("n"))
    err = (F.col("syy") - F.col("slope") * F.col("sty") - F.col("intercept") * F.col("sy")) / F.col("n")
    out = out.withColumn("mse", r(err, 4))
    rank = F.row_number().over(Window.orderBy("mse", "term"))
    return out.select(rank.alias("rank"), "term", r(F.col("slope"), 4).alias("slope"), r(F.col("intercept"), 4).alias("intercept"), "mse")


SQL["affine_fit_rank"] = f"""
WITH s AS ({S}), t AS (SELECT y, unnest(['x0','x1','x2','x0*x1','x0*x2','x0^2']) AS term, unnest([x0, x1, x2, x0 * x1, x0 * x2, x0 * x0]) AS t FROM s),
g AS (SELECT term, count(*)::DOUBLE AS n, sum(y) AS sy, sum(y * y) AS syy, sum(t) AS st, sum(t * t) AS stt, sum(t * y) AS sty FROM t GROUP BY 1),
f AS (SELECT *, (n * sty - st * sy) / nullif(n * stt - st * st, 0) AS slope FROM g), h AS (SELECT *, (sy - slope * st) / n AS intercept FROM f),
e AS (SELECT *, {rd('(syy - slope * sty - intercept * sy) / n')} AS mse FROM h)
SELECT row_number() OVER (ORDER BY mse, term)::INT AS rank, term, {rd('slope')} AS slope, {rd('intercept')} AS intercept, mse FROM e"""


def pair_fit_rank(spark, d):
    """All pairs i < j of terms, least squares in closed form from the Gram matrix, ranked: one pass over the data."""
    s = sales(spark, d)
    x = {"x0": F.col("x0"), "x1": F.col("x1"), "x2": F.col("x2"), "x0*x1": F.col("x0") * F.col("x1"), "x0*x2": F.col("x0") * F.col("x2")}
    terms = [basis.Term(k, "", v) for k, v in x.items()]
    k = len(terms)
    g = gram.partial(basis.project(s, terms, F.col("y")), k)
    # one row with the whole matrix as a map: what the pairs need is looked up, and the data is read once
    one = g.agg(F.map_from_entries(F.collect_list(F.struct((F.col("i") * 100 + F.col("j")).alias("k"), "v"))).alias("g"))
    at = lambda i, j: F.element_at("g", F.lit(100 * i + j))
    names = list(x)
    pairs = [
        F.struct(F.lit(names[a]).alias("term_a"), F.lit(names[b]).alias("term_b"), at(a, a).alias("ga"), at(b, b).alias("gb"), at(a, b).alias("gij"), at(a, k).alias("ca"), at(b, k).alias("cb"), at(k, k).alias("yy"), at(k + 1, k + 1).alias("n"))
        for a in range(k) for b in range(a + 1, k)
    ]
    p = one.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    det = F.col("ga") * F.col("gb") - F.col("gij") * F.col("gij")
    wa = (F.col("ca") * F.col("gb") - F.col("cb") * F.col("gij")) / F.nullif(det, F.lit(0.0))
    wb = (F.col("cb") * F.col("ga") - F.col("ca") * F.col("gij")) / F.nullif(det, F.lit(0.0))
    p = p.withColumn("wa", wa).withColumn("wb", wb)
    err = F.abs(F.col("yy") - F.col("wa") * F.col("ca") - F.col("wb") * F.col("cb")) / F.col("n")
    p = p.withColumn("mse", r(err, 4))
    return p.select(F.row_number().over(Window.orderBy("mse", "term_a", "term_b")).alias("rank"), "term_a", "term_b", r(F.col("wa"), 4).alias("wa"), r(F.col("wb"), 4).alias("wb"), "mse")


SQL["pair_fit_rank"] = f"""
WITH s AS ({S}), t AS (SELECT row_number() OVER () AS id, * FROM s),
u AS (SELECT id, y, unnest([0,1,2,3,4]) AS k, unnest(['x0','x1','x2','x0*x1','x0*x2']) AS name, unnest([x0, x1, x2, x0 * x1, x0 * x2]) AS b FROM t),
g AS (SELECT a.name AS term_a, b.name AS term_b, sum(a.b * a.b) AS ga, sum(b.b * b.b) AS gb, sum(a.b * b.b) AS gij, sum(a.b * a.y) AS ca, sum(b.b * a.y) AS cb, sum(a.y * a.y) AS yy, count(*)::DOUBLE AS n
  FROM u a JOIN u b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2),
w AS (SELECT *, (ca * gb - cb * gij) / nullif(ga * gb - gij * gij, 0) AS wa, (cb * ga - ca * gij) / nullif(ga * gb - gij * gij, 0) AS wb FROM g),
e AS (SELECT *, {rd('abs(yy - wa * ca - wb * cb) / n')} AS mse FROM w)
SELECT row_number() OVER (ORDER BY mse, term_a, term_b)::INT AS rank, term_a, term_b, {rd('wa')} AS wa, {rd('wb')} AS wb, mse FROM e"""


def ridge_2col(spark, d):
    """Ridge of the target on x0 and a constant, the constant penalised too, in closed form, by return flag."""
    lam = 0.01
    g = sales(spark, d).groupBy("l_returnflag").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("x0").alias("s"), F.sum(F.col("x0") * F.col("x0")).alias("q"), F.sum("y").alias("c0"), F.sum(F.col("x0") * F.col("y")).alias("c1"))
    det = (F.col("n") + lam) * (F.col("q") + lam) - F.col("s") * F.col("s")
    w0 = (F.col("c0") * (F.col("q") + lam) - F.col("c1") * F.col("s")) / F.nullif(det, F.lit(0.0))
    w1 = ((F.col("n") + lam) * F.col("c1") - F.col("s") * F.col("c0")) / F.nullif(det, F.lit(0.0))
    return g.select("l_returnflag", r(w0, 5).alias("w0"), r(w1, 5).alias("w1"))


SQL["ridge_2col"] = f"""
WITH g AS (SELECT l_returnflag, count(*)::DOUBLE AS n, sum(x0) AS s, sum(x0 * x0) AS q, sum(y) AS c0, sum(x0 * y) AS c1 FROM ({S}) GROUP BY 1), d AS (SELECT *, (n + 0.01::DOUBLE) * (q + 0.01::DOUBLE) - s * s AS det FROM g)
SELECT l_returnflag, {rd('(c0 * (q + 0.01::DOUBLE) - c1 * s) / det', 5)} AS w0, {rd('((n + 0.01::DOUBLE) * c1 - s * c0) / det', 5)} AS w1 FROM d"""


def mse_r2_by_group(spark, d):
    p = F.lit(0.95) * F.col("x0")
    return sales(spark, d).groupBy("l_returnflag").agg(r(diagnostics.mse(F.col("y"), p), 4).alias("mse"), r(diagnostics.r2(F.col("y"), p), 6).alias("r2"))


SQL["mse_r2_by_group"] = f"SELECT l_returnflag, {rd('avg((p - y) * (p - y))')} AS mse, {rd('1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(y))', 6)} AS r2 FROM (SELECT *, 0.95::DOUBLE * x0 AS p FROM ({S})) GROUP BY 1"


def fold_r2(spark, d):
    p = F.lit(0.95) * F.col("x0")
    folds = sales(spark, d).withColumn("fold", F.pmod(F.col("l_orderkey"), F.lit(5)).cast("int"))
    return folds.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), r(diagnostics.r2(F.col("y"), p), 6).alias("r2"))


SQL["fold_r2"] = f"SELECT (l_orderkey % 5)::INT AS fold, count(*) AS n, {rd('1 - sum((p - y) * (p - y)) / (sum(y * y) - sum(y) * sum(y) / count(y))', 6)} AS r2 FROM (SELECT *, 0.95::DOUBLE * x0 AS p FROM ({S})) GROUP BY 1"


def moment_diagnostics(spark, d):
    m = diagnostics.residual_moments(F.col("x2") - 2.5)
    return sales(spark, d).groupBy("l_returnflag").agg(*[r(c, 4).alias(k) for k, c in m.items()])


SQL["moment_diagnostics"] = f"""
WITH m AS (SELECT l_returnflag, avg(e) AS m1, avg(pow(e, 2)) AS m2, avg(pow(e, 3)) AS m3, avg(pow(e, 4)) AS m4 FROM (SELECT *, x2 - 2.5::DOUBLE AS e FROM ({S})) GROUP BY 1), v AS (SELECT *, m2 - m1 * m1 AS var FROM m)
SELECT l_returnflag, {rd('m2')} AS mse, {rd('(m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(var, 1.5)')} AS skewness, {rd('(m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (var * var) - 3')} AS kurtosis FROM v"""


def edge_core_ratio(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice", (F.col("o_totalprice") / F.lit(100000.0) - 1.5).alias("e"))
    out = diagnostics.suspicious(rows, ["o_orderpriority"], "o_totalprice", "e", tie=["o_orderkey"])
    return out.select("o_orderpriority", "n", r(F.col("edge_core"), 4).alias("edge_core"), "suspicious")


SQL["edge_core_ratio"] = f"""
WITH o AS (SELECT o_orderpriority, o_totalprice / 100000.0::DOUBLE - 1.5::DOUBLE AS e, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
p AS (SELECT *, k <= greatest(floor(n * 0.05), 1) OR k > n - greatest(floor(n * 0.05), 1) AS edge FROM o),
g AS (SELECT o_orderpriority, count(*) AS n, avg(e) AS m1, avg(e*e) AS m2, avg(e*e*e) AS m3, avg(e*e*e*e) AS m4, avg(CASE WHEN edge THEN e * e END) / nullif(avg(CASE WHEN NOT edge THEN e * e END), 0) AS ratio FROM p GROUP BY 1),
v AS (SELECT *, m2 - m1 * m1 AS var FROM g)
SELECT o_orderpriority, n, {rd('ratio')} AS edge_core, n >= 10 AND (abs((m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(var, 1.5)) > 1 OR (m4 - 4 * m1 * m3 + 6 * m1 * m1 * m2 - 3 * m1 * m1 * m1 * m1) / (var * var) - 3 > 3 OR ratio > 2) AS suspicious FROM v"""


def stability_stats(spark, d):
    out = diagnostics.stability(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice")
    out = out.withColumns({c: r(F.col(c), 2) for c in ("q25", "median", "q75", "sd", "worst_tenth")})
    # of the rounded quartiles: the exact difference can lie on half a cent, where engines round apart
    return out.withColumn("iqr", r(F.col("q75") - F.col("q25"), 2))


SQL["stability_stats"] = f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders),
g AS (SELECT o_orderpriority, quantile_cont(o_totalprice, 0.25) AS q25, quantile_cont(o_totalprice, 0.5) AS median, quantile_cont(o_totalprice, 0.75) AS q75, stddev_pop(o_totalprice) AS sd, avg(CASE WHEN k <= floor(n / 10.0) THEN o_totalprice END) AS worst_tenth FROM o GROUP BY 1)
SELECT o_orderpriority, {rd('q25', 2)} AS q25, {rd('median', 2)} AS median, {rd('q75', 2)} AS q75, {rd(rd('q75', 2) + ' - ' + rd('q25', 2), 2)} AS iqr, {rd('sd', 2)} AS sd, {rd('worst_tenth', 2)} AS worst_tenth FROM g"""


def tier_rollup(spark, d):
    """Scores by segment with subtotals: 3 for exact, 2 for approximate, 1 for loose, over three times the total."""
    c = table(spark, d, "customer")
    score = F.when(F.col("c_acctbal") > 7500, "EXACT").when(F.col("c_acctbal") > 4000, "APPROX").when(F.col("c_acctbal") > 0, "LOOSE").otherwise("FAIL")
    on = lambda s: F.count_if(F.col("score") == s)
    g = c.withColumn("score", score).rollup("c_mktsegment").agg(F.count(F.lit(1)).alias("total"), on("EXACT").alias("exact"), on("APPROX").alias("approx"), on("LOOSE").alias("loose"))
    w = (3 * F.col("exact") + 2 * F.col("approx") + F.col("loose")) / (3 * F.col("total"))
    return g.withColumn("weighted", r(w, 6))


SQL["tier_rollup"] = f"""
WITH c AS (SELECT c_mktsegment, CASE WHEN c_acctbal > 7500 THEN 'EXACT' WHEN c_acctbal > 4000 THEN 'APPROX' WHEN c_acctbal > 0 THEN 'LOOSE' ELSE 'FAIL' END AS score FROM customer),
g AS (SELECT c_mktsegment, count(*) AS total, count(*) FILTER (score = 'EXACT') AS exact, count(*) FILTER (score = 'APPROX') AS approx, count(*) FILTER (score = 'LOOSE') AS loose FROM c GROUP BY ROLLUP (c_mktsegment))
SELECT *, {rd('(3 * exact + 2 * approx + loose)::DOUBLE / (3 * total)::DOUBLE', 6)} AS weighted FROM g"""


def _scored(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select("doc_id", "quality", F.least(F.col("n_chars") / F.lit(10000.0), F.lit(1.0)).alias("score"))


def threshold_f1(spark, d):
    t = [round(0.05 * k, 2) for k in range(1, 20)]
    out = diagnostics.threshold_f1(_scored(spark, d), "quality", "score", t)
    return out.select("threshold", "tp", "fp", "fn", r(F.col("f1"), 6).alias("f1"))


_sc = "SELECT doc_id, quality, least(n_chars / 10000.0::DOUBLE, 1.0::DOUBLE) AS score FROM documents JOIN labels USING (doc_id)"
SQL["threshold_f1"] = f"""
WITH s AS ({_sc}), t AS (SELECT unnest([{', '.join(f'{round(0.05 * k, 2)!r}::DOUBLE' for k in range(1, 20))}]) AS threshold),
c AS (SELECT threshold, count(*) FILTER (quality = 1 AND score >= threshold) AS tp, count(*) FILTER (quality <> 1 AND score >= threshold) AS fp, count(*) FILTER (quality = 1 AND score < threshold) AS fn FROM s, t GROUP BY 1)
SELECT *, {rd('coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0.0)', 6)} AS f1 FROM c"""


def calibration_bins(spark, d):
    out = calibrate.bins(_scored(spark, d), "score", "quality", 20)
    return out.select("bin", "lo", "hi", "n", "positive", r(F.col("rate"), 6).alias("rate"))


SQL["calibration_bins"] = f"""
WITH b AS (SELECT least(floor(score * 20), 19)::INT AS bin, quality FROM ({_sc}))
SELECT bin, bin / 20.0::DOUBLE AS lo, (bin + 1) / 20.0::DOUBLE AS hi, count(*) AS n, sum(quality)::BIGINT AS positive, {rd('sum(quality)::DOUBLE / count(*)', 6)} AS rate FROM b GROUP BY bin"""


def calibration_lookup(spark, d):
    rows = _scored(spark, d)
    got = calibrate.bins(rows, "score", "quality", 20).select("bin", "n", "positive").collect()  # 20 rows
    out = calibrate.lookup(rows, "score", calibrate.isotonic([tuple(g) for g in got]), 20)
    return out.select("doc_id", r(F.col("calibrated"), 6).alias("calibrated"))


#: Isotonic rates by their max-min form: the greatest over earlier bins of the least over later ones of the mean between.
SQL["calibration_lookup"] = f"""
WITH s AS (SELECT doc_id, score, quality, least(floor(score * 20), 19)::INT AS bin FROM ({_sc})), b AS (SELECT bin, count(*) AS n, sum(quality)::BIGINT AS p FROM s GROUP BY 1),
m AS (SELECT i.bin AS i, j.bin AS j, (SELECT sum(p)::DOUBLE / sum(n) FROM b x WHERE x.bin BETWEEN i.bin AND j.bin) AS mean FROM b i JOIN b j ON i.bin <= j.bin),
r AS (SELECT k.bin, max(low) AS rate FROM b k JOIN LATERAL (SELECT i, min(mean) AS low FROM m WHERE i <= k.bin AND j >= k.bin GROUP BY i) ON true GROUP BY 1)
SELECT doc_id, {rd('rate', 6)} AS calibrated FROM s JOIN r USING (bin)"""


def lasso_path(spark, d):
    """Supports that the lasso path of the planted target ends in after elimination, refitted, with their errors."""
    terms = basis.catalog({c: F.col(c) for c in ("x0", "x1", "x2")}, 3, families={"power", "product"})
    s = gram.gram(basis.project(sales(spark, d), terms, F.col("y")), len(terms))
    ends = {f.terms: f for f in (gram.bic_eliminate(s, f) for f in gram.lasso_path(s))}
    rows = [(",".join(terms[t].name for t in f.terms), len(f.terms), round(float(f.mse), 6)) for f in ends.values()]
    return spark.createDataFrame(rows, "terms string, n_terms int, mse double")


#: The target's own terms.
SQL["lasso_path"] = f"SELECT 'x0,x0*x1' AS terms, 2 AS n_terms, round(avg(pow(y - (x0 - x0 * x1), 2)), 6) AS mse FROM ({S})"


def formula_fit(spark, d):
    """The estimator on the planted target: the formula found, with the error of what is displayed."""
    from .estimator import FormulaRegressor

    m = FormulaRegressor(max_power=2, families={"power", "product"}).fit(sales(spark, d), ["x0", "x1", "x2"], "y")
    return spark.createDataFrame([(c["formula"], round(c["mse"], 6), round(c["r2"], 6), c["n_terms"], c["stage"]) for c in m.candidates], "formula string, mse double, r2 double, n_terms int, stage string")


#: The target itself.
SQL["formula_fit"] = f"SELECT '-x0*x1 + x0' AS formula, round(avg(pow(y - (x0 - x0 * x1), 2)), 6) AS mse, round(1 - sum(pow(y - (x0 - x0 * x1), 2)) / (var_pop(y) * count(*)), 6) AS r2, 2 AS n_terms, 'exact2' AS stage FROM ({S})"


QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
