"""Queries over decision rules, importance, templates, generated formulas and noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import graph
from ..functions.safe import corner_weights
from ..functions.safe import rounded as r
from ..operators import decide, refine
from ..sources.tables import sales, table
from .fitting import S, rd
from .scalar import KEY, ROW

SQL: dict[str, str] = {}
GRAPH = {
    "nodes": [
        graph.node("input", feature=0), graph.node("input", feature=1), graph.node("constant", value=2.5), graph.node("unary", op="int_power", p=2.0, left=0),
        graph.node("binary", op="arithmetic", beta=2.0, gamma=1.0, left=3, right=1), graph.node("unary", op="periodic", omega=0.5, phi=0.1, amplitude=1.5, left=4),
        graph.node("binary", op="division", left=5, right=2),
    ],
    "weights": [0.5, 0.0, 0.0, 0.25, 1.0, -2.0, 3.0], "bias": 0.125,
}


def graph_struct_eval(spark, d):
    """A graph in its row form, compiled to one expression."""
    rows = table(spark, d, "lineitem")
    y = graph.to_column(GRAPH, [F.col("l_quantity") / F.lit(10.0), F.col("l_discount")])
    return rows.select(*ROW, r(y, 4).alias("y"))


_w = corner_weights(2.0, 1.0)
SQL["graph_struct_eval"] = f"""
WITH a AS (SELECT {KEY}, l_quantity / 10.0::DOUBLE AS x0, l_discount AS x1 FROM lineitem), b AS (SELECT *, pow(x0, 2.0::DOUBLE) AS n3 FROM a),
c AS (SELECT *, {_w['add']!r}::DOUBLE * (n3 + x1) + {_w['mul']!r}::DOUBLE * (n3 * x1) + {_w['div']!r}::DOUBLE * (n3 / (abs(x1) + 1e-6) * sign(x1)) + {_w['sub']!r}::DOUBLE * (n3 - x1) AS n4 FROM b),
d AS (SELECT *, 1.5::DOUBLE * sin(0.5::DOUBLE * n4 + 0.1::DOUBLE) AS n5 FROM c), e AS (SELECT *, n5 / (abs(2.5::DOUBLE) + 1e-6) * sign(2.5::DOUBLE) AS n6 FROM d)
SELECT {KEY}, {rd('0.125::DOUBLE + 0.5::DOUBLE * x0 + 0.25::DOUBLE * n3 + 1.0::DOUBLE * n4 + (-2.0)::DOUBLE * n5 + 3.0::DOUBLE * n6')} AS y FROM e"""


def soft_rounding(spark, d):
    v = F.col("p_retailprice") / F.lit(100.0)
    return table(spark, d, "part").select("p_partkey", r(decide.soft_round(v), 6).alias("soft"), r(decide.rounding_loss(v), 6).alias("loss"))


SQL["soft_rounding"] = f"SELECT p_partkey, {rd('v - sin(2 * pi() * v) / (2 * pi() * 5)', 6)} AS soft, {rd('pow(least(v - floor(v), 1.0::DOUBLE - (v - floor(v))), 2)', 6)} AS loss FROM (SELECT p_partkey, p_retailprice / 100.0::DOUBLE AS v FROM part)"


def hoyer_sparsity(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(r(decide.hoyer(F.col("value")), 6).alias("hoyer"))


SQL["hoyer_sparsity"] = f"SELECT user_id, {rd('(sqrt(count(*)::DOUBLE) - sum(abs(value)) / sqrt(sum(value * value))) / (sqrt(count(*)::DOUBLE) - 1.0::DOUBLE + 1e-8)', 6)} AS hoyer FROM events GROUP BY 1"


def risk_seeking(spark, d):
    rows = table(spark, d, "part").select("p_partkey", "p_brand", (F.col("p_retailprice") / F.lit(100.0)).alias("f"))
    out = decide.risk_seeking(rows, ["p_brand"], "f")
    return out.select("p_partkey", "p_brand", r(F.col("p"), 6).alias("p"), r(F.col("threshold"), 4).alias("threshold"))


SQL["risk_seeking"] = f"""
WITH x AS (SELECT p_partkey, p_brand, p_retailprice / 100.0::DOUBLE AS f FROM part), c AS (SELECT p_brand, quantile_cont(f, 0.25) AS t, min(f) AS low FROM x GROUP BY 1), e AS (SELECT *, exp((low - f) / 1.0::DOUBLE) AS e FROM x JOIN c USING (p_brand))
SELECT p_partkey, p_brand, {rd('e / sum(e) OVER (PARTITION BY p_brand)', 6)} AS p, {rd('t')} AS threshold FROM e"""


def ablation_importance(spark, d):
    terms = {"x0": F.col("x0"), "x0*x1": F.col("x0") * F.col("x1"), "x2": F.col("x2")}
    out = decide.ablation(sales(spark, d), terms, {"x0": 1.0, "x0*x1": -1.0, "x2": 0.001}, "y")
    return out.select("term", r(F.col("mse_without"), 6).alias("mse_without"), "level")


SQL["ablation_importance"] = f"""
WITH s AS ({S}), b AS (SELECT avg(pow(x0 - x0 * x1 + 0.001 * x2 - y, 2)) AS base, avg(pow(-x0 * x1 + 0.001 * x2 - y, 2)) AS m0, avg(pow(x0 + 0.001 * x2 - y, 2)) AS m1, avg(pow(x0 - x0 * x1 - y, 2)) AS m2 FROM s),
t AS (SELECT base, unnest(['x0', 'x0*x1', 'x2']) AS term, unnest([m0, m1, m2]) AS m FROM b), g AS (SELECT *, CASE WHEN base <= 1e-10 THEN m ELSE (m - base) / base END AS gain FROM t)
SELECT term, {rd('m', 6)} AS mse_without, CASE WHEN gain > 1 THEN 'critical' WHEN gain > 0.1 THEN 'important' ELSE 'minor' END AS level FROM g"""


def _runs(spark, d):
    """Orders as runs: priority the problem, prices the quality."""
    q = F.col("o_totalprice") / F.lit(400000.0)
    return table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("problem"), (F.lit(1.0) - q * q).alias("r2"), (F.col("o_totalprice") < 20000).alias("exact"), (F.col("o_orderkey") % 40).cast("int").alias("size"), (F.col("o_orderkey") % 97).cast("double").alias("seconds"))


R = "SELECT o_orderkey, o_orderpriority AS problem, 1.0::DOUBLE - (o_totalprice / 400000.0::DOUBLE) * (o_totalprice / 400000.0::DOUBLE) AS r2, o_totalprice < 20000 AS exact, (o_orderkey % 40)::INT AS size, (o_orderkey % 97)::DOUBLE AS seconds FROM orders"


def seed_summary(spark, d):
    out = decide.seed_summary(_runs(spark, d), "problem")
    return out.withColumns({c: r(F.col(c), 6) for c in ("r2_median", "r2_sd")})


SQL["seed_summary"] = f"SELECT problem, count(*) AS n, {rd('quantile_cont(r2, 0.5)', 6)} AS r2_median, count(*) FILTER (exact) AS n_exact, min(seconds) FILTER (exact) AS first_exact_s, min(seconds) FILTER (r2 >= 0.99 AND size <= 20) AS first_acceptable_s, {rd('stddev_pop(r2)', 6)} AS r2_sd FROM ({R}) GROUP BY 1"
TRUTHS = ("exp(-x)*sin(x)", "x**4 + x", "1/(x+1)", "x^2", "cos(2*x)")
FOUND = ("exp(x)", "x^2 + x", "sin(x)", "", "x**4/x", "exp(-x)/x**5", "cos(x) + X^3")


def failure_buckets(spark, d):
    pick = lambda v, n: F.element_at(F.array(*map(F.lit, v)), (F.pmod(F.floor(F.col("o_orderkey") / F.lit(float(n))).cast("long"), F.lit(len(v))) + 1).cast("int"))
    rows = _runs(spark, d).withColumn("bucket", decide.failure_bucket(pick(FOUND, 1), F.col("r2"), F.col("seconds") / F.lit(50.0), pick(TRUTHS, 7)))
    return rows.groupBy("problem", "bucket").agg(F.count(F.lit(1)).alias("n"))


_pick = lambda v, n: f"[{', '.join(repr(x) for x in v)}][(floor(o_orderkey / {n}.0::DOUBLE)::BIGINT % {len(v)} + 1)::INT]"
_power = lambda c: rf"list_max(list_transform(regexp_extract_all({c}, '(?:\*\*|\^)\s*(\d+)', 1), lambda k: k::INT))"
SQL["failure_buckets"] = rf"""
WITH f AS (SELECT *, lower({_pick(FOUND, 1)}) AS f, lower({_pick(TRUTHS, 7)}) AS t, seconds / 50.0::DOUBLE AS mse FROM ({R})), p AS (SELECT *, {_power('f')} AS fp, {_power('t')} AS tp FROM f)
SELECT problem, CASE WHEN f = '' THEN 'no_formula' WHEN contains(t, 'exp(-') AND contains(f, 'exp(') AND NOT contains(f, 'exp(-') THEN 'exp_sign_error' WHEN contains(t, '/') AND NOT contains(f, '/') THEN 'rational_denominator_missing'
  WHEN tp >= 3 AND coalesce(fp, 1) < tp THEN 'missing_high_order_terms' WHEN (contains(t, 'sin(') OR contains(t, 'cos(')) AND NOT (contains(f, 'sin(') OR contains(f, 'cos(')) THEN 'periodic_structure_missing'
  WHEN r2 >= 0.8 THEN 'near_miss_structural' WHEN mse > 1 THEN 'high_error_instability' ELSE 'other_structural_failure' END AS bucket, count(*) AS n FROM p GROUP BY 1, 2"""


def _best(spark, d):
    from pyspark.sql.window import Window

    e = table(spark, d, "events").select("user_id", "ts", "value")
    return e.withColumn("best", F.min("value").over(Window.partitionBy("user_id").orderBy("ts")))


B = "SELECT user_id, ts, value, min(value) OVER (PARTITION BY user_id ORDER BY ts) AS best FROM events"


def restart_test(spark, d):
    return decide.restart(_best(spark, d), ["user_id"], "ts", "best", 40).filter("restart").groupBy("user_id").agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))


SQL["restart_test"] = f"WITH l AS (SELECT *, lag(best, 39) OVER (PARTITION BY user_id ORDER BY ts) AS old FROM ({B})) SELECT user_id, min(ts) AS first, count(*) AS n FROM l WHERE old IS NOT NULL AND old - best < 0.01::DOUBLE * abs(old) GROUP BY 1"


def stuck_detector(spark, d):
    return decide.stuck(_best(spark, d), ["user_id"], "ts", "value", 10, 5.0).groupBy("user_id").agg(F.count_if(F.col("stuck")).alias("n_stuck"))


SQL["stuck_detector"] = f"""
WITH w AS (SELECT user_id, avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND 5 PRECEDING) AS a, avg(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS b, count(*) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS n FROM ({B}))
SELECT user_id, count(*) FILTER (n = 10 AND abs(a - b) < 5.0) AS n_stuck FROM w GROUP BY 1"""


def explosion_detector(spark, d):
    return decide.exploding(_best(spark, d), ["user_id"], "ts", "value", 9, 3.0).filter("exploding").select("user_id", "ts", "value")


SQL["explosion_detector"] = f"WITH w AS (SELECT user_id, ts, value, median(value) OVER x AS m, count(*) OVER x AS n FROM ({B}) WINDOW x AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW)) SELECT user_id, ts, value FROM w WHERE n >= 5 AND value > 3.0::DOUBLE * m"


def classifier_scores(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select("lang", "quality", F.when(F.col("n_chars") > 1500, 1).otherwise(0).alias("predicted"))
    out = decide.classifier_scores(docs, "lang", "quality", "predicted")
    return out.withColumn("f1", r(F.col("f1"), 6))


SQL["classifier_scores"] = f"""
WITH x AS (SELECT lang, quality, CASE WHEN n_chars > 1500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, count(*) FILTER (quality = 1 AND p = 1) AS tp, count(*) FILTER (quality <> 1 AND p = 1) AS fp, count(*) FILTER (quality = 1 AND p <> 1) AS fn FROM x GROUP BY ROLLUP (lang))
SELECT *, {rd('coalesce(2 * tp / nullif((2 * tp + fp + fn)::DOUBLE, 0), 0.0)', 6)} AS f1 FROM g"""


def op_cdf(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).cast("double").alias("prior"))
    return decide.op_cdf(n, "event_type", "prior").select("event_type", r(F.col("cdf"), 6).alias("cdf"))


SQL["op_cdf"] = f"WITH n AS (SELECT event_type, count(*)::DOUBLE AS prior FROM events GROUP BY 1) SELECT event_type, {rd('sum(prior) OVER (ORDER BY event_type) / sum(prior) OVER ()', 6)} AS cdf FROM n"


#: Payloads and what is wrong with them.
PAYLOADS = {
    '{"schema_version":"fpip.v2","candidate_skeletons":[{"formula":"x"}],"sequence_uncertainty":{},"operator_priors":{},"routing_signal":{"recommend_guided_evolution":false,"reason":"ok"}}': [],
    '{"schema_version":"fpip.v1","candidate_skeletons":[],"sequence_uncertainty":[],"operator_priors":{"sin":1},"routing_signal":{"reason":null}}': ["schema_version must be 'fpip.v2'", "candidate_skeletons must be a non-empty list", "sequence_uncertainty must be a dict", "routing_signal.recommend_guided_evolution is required"],
    '{"schema_version":"fpip.v2","candidate_skeletons":[{"formula":" "},{"formula":"x"},7],"sequence_uncertainty":{"entropy":1},"routing_signal":{}}': ["candidate_skeletons[0] must include formula", "candidate_skeletons[2] must include formula", "operator_priors must be a dict", "routing_signal.recommend_guided_evolution is required", "routing_signal.reason is required"],
    "{}": ["schema_version must be 'fpip.v2'", "candidate_skeletons must be a non-empty list", "sequence_uncertainty must be a dict", "operator_priors must be a dict", "routing_signal must be a dict"],
    "[1]": ["payload must be a dict"], "not json": ["payload must be a dict"],
}


def payload_validation(spark, d):
    body = F.element_at(F.array(*map(F.lit, PAYLOADS)), (F.col("c_custkey") % len(PAYLOADS) + 1).cast("int"))
    rows = decide.payload_errors(table(spark, d, "customer").select("c_custkey", body.alias("payload")), "payload")
    return rows.select(F.array_join("errors", "; ").alias("errors")).groupBy("errors").agg(F.count(F.lit(1)).alias("n"))


SQL["payload_validation"] = "SELECT [{}][(c_custkey % {} + 1)::INT] AS errors, count(*) AS n FROM customer GROUP BY 1".format(", ".join("'" + "; ".join(e).replace("'", "''") + "'" for e in PAYLOADS.values()), len(PAYLOADS))


def template_match(spark, d):
    rows = sales(spark, d).withColumn("t", F.sqrt(F.col("x1") * F.col("x1") + F.col("x2") * F.col("x2")))
    out = refine.match_templates(rows, {"x1": F.col("x1"), "x2": F.col("x2")}, "t")
    return out.select("template", r(F.col("slope"), 6).alias("slope"), r(F.col("r2"), 6).alias("r2"))


_shape = {"sqrt(x1^2 + x2^2)": "sqrt(x1 * x1 + x2 * x2)", "x1/sqrt(1 - x2^2)": "x1 / nullif(sqrt(greatest(1.0 - x2 * x2, 0.0)), 0)", "x2/sqrt(1 - x1^2)": "x2 / nullif(sqrt(greatest(1.0 - x1 * x1, 0.0)), 0)", "exp(-x1)*cos(x2)": "exp(-x1) * cos(x2)", "exp(-x2)*cos(x1)": "exp(-x2) * cos(x1)"}
SQL["template_match"] = f"""
WITH s AS (SELECT x1, x2, sqrt(x1 * x1 + x2 * x2) AS t FROM ({S})), l AS (SELECT t, unnest([{', '.join(repr(k) for k in _shape)}]) AS template, unnest([{', '.join(f'({q})::DOUBLE' for q in _shape.values())}]) AS v FROM s),
g AS (SELECT template, sum(v * v) AS a, sum(v * t) AS b, sum(CASE WHEN v IS NOT NULL THEN t * t END) AS c FROM l GROUP BY 1)
SELECT template, {rd('b / nullif(a, 0)', 6)} AS slope, {rd('1 - (c - b / nullif(a, 0) * b) / nullif(c, 0)', 6)} AS r2 FROM g"""


def formula_corpus(spark, d):
    """A generated formula for every part."""
    return refine.formulas_for(table(spark, d, "part"), "p_partkey", 1)


def noise_profiles(spark, d):
    """Events by user as noisy curves: how far each profile moves them."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    out = refine.noisy(e, "user_id", "event_id", "value")
    return out.groupBy("profile").agg(F.countDistinct("user_id").alias("curves"), r(F.avg(F.abs(F.col("noisy") - F.col("value"))), 4).alias("mean_change"))


_u = lambda *c: f"((('0x' || substr(md5(concat_ws('|', {', '.join(c)})), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / {float(1 << 52)!r}::DOUBLE)"
_z = lambda *c: f"(sqrt(-2.0::DOUBLE * ln({_u(repr('a'), *c)})) * cos(2 * pi() * {_u(repr('b'), *c)}))"
_s = lambda lo, hi: f"({lo!r}::DOUBLE + {hi - lo!r}::DOUBLE * {_u(repr('s'), repr('0'), 'user_id')})"
SQL["noise_profiles"] = f"""
WITH e AS (SELECT user_id, value, {_u("'p'", "'0'", "user_id")} AS u, row_number() OVER (w ORDER BY event_id) - 1 AS k, count(*) OVER w AS n, stddev_pop(value) OVER w + 1e-10 AS sd, min(value) OVER w AS lo, max(value) OVER w AS hi FROM events WINDOW w AS (PARTITION BY user_id)),
p AS (SELECT *, CASE WHEN u < 0.2 THEN 'clean' WHEN u < 0.45 THEN 'low' WHEN u < 0.65 THEN 'medium' WHEN u < 0.75 THEN 'high' WHEN u < 0.85 THEN 'pink' WHEN u < 0.95 THEN 'quantised' ELSE 'outliers' END AS profile,
  {_z("'0'", "user_id", "'w'", "k")} AS z, {' + '.join(_z("'0'", "user_id", f"'{o}'", f"k // {1 << o}") for o in range(6))} AS pink, {_u("'o'", "'0'", "user_id", "k")} AS o FROM e),
q AS (SELECT *, stddev_pop(pink) OVER (PARTITION BY user_id) + 1e-10 AS psd, row_number() OVER (PARTITION BY user_id ORDER BY o, k) AS r, pow(2.0::DOUBLE, floor({_u("'l'", "'0'", "user_id")} * 5) + 4) AS levels, hi - lo + 1e-10 AS span FROM p),
x AS (SELECT *, CASE profile WHEN 'quantised' THEN floor((value - lo) / span * levels + 0.5) / levels * span + lo - value WHEN 'pink' THEN pink / psd * {_s(0.01, 0.05)} * sd WHEN 'low' THEN {_s(0.003, 0.01)} * sd * z
  WHEN 'medium' THEN {_s(0.01, 0.05)} * sd * z WHEN 'high' THEN {_s(0.1, 0.3)} * sd * z WHEN 'outliers' THEN CASE WHEN r <= greatest(floor(n * {_s(0.01, 0.05)}), 1) THEN 3.0::DOUBLE * sd * z ELSE 0.0::DOUBLE END ELSE 0.0::DOUBLE END AS change FROM q)
SELECT profile, count(DISTINCT user_id) AS curves, {rd('avg(abs(change))')} AS mean_change FROM x GROUP BY 1"""


def omega_refine(spark, d):
    """The frequency of a planted wave at the uneven times of each user's events; a user is a curve."""
    x = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)") / F.lit(864e8 * 1.5)
    e = table(spark, d, "events").select("user_id", x.alias("x"))
    curves = e.withColumn("y", 2.0 * F.sin((F.lit(0.6) + (F.col("user_id") % 8) * 0.4) * F.col("x") + 0.3) + 1.0)
    return refine.refine_omega(curves, "user_id", "x", "y").select("user_id", F.round("omega", 4).alias("omega"), F.round("mse", 8).alias("mse"))


#: The frequencies that the curves were made with.
SQL["omega_refine"] = "SELECT user_id, floor((0.6::DOUBLE + user_id % 8 * 0.4::DOUBLE) * 10000.0 + 0.5) / 10000.0 AS omega, 0.0::DOUBLE AS mse FROM (SELECT DISTINCT user_id FROM events)"


def subset_selection(spark, d):
    t = {"x0": F.col("x0"), "x1": F.col("x1"), "x2": F.col("x2"), "x0*x1": F.col("x0") * F.col("x1")}
    return refine.subset_by_size(sales(spark, d), t, "y").select("n_terms", "terms", F.round("mse", 6).alias("mse"), "chosen")


#: The best single and pair by their normal equations; more terms are the exact pair and the first others.
SQL["subset_selection"] = f"""
WITH s AS ({S}), t AS (SELECT row_number() OVER () AS id, * FROM s), u AS (SELECT id, y, unnest(['x0', 'x1', 'x2', 'x0*x1']) AS name, unnest([0, 1, 2, 3]) AS k, unnest([x0, x1, x2, x0 * x1]) AS b FROM t),
one AS (SELECT name AS terms, k, greatest((sum(y * y) - sum(b * y) * sum(b * y) / sum(b * b)) / count(*), 0) AS m FROM u GROUP BY 1, 2),
g AS (SELECT a.name || ',' || b.name AS terms, a.k AS i, b.k AS j, sum(a.b * a.b) AS ga, sum(b.b * b.b) AS gb, sum(a.b * b.b) AS gij, sum(a.b * a.y) AS ca, sum(b.b * a.y) AS cb, sum(a.y * a.y) AS yy, count(*) AS n FROM u a JOIN u b ON a.id = b.id AND a.k < b.k GROUP BY 1, 2, 3),
two AS (SELECT terms, i, j, greatest((yy - ((ca * gb - cb * gij) * ca + (cb * ga - ca * gij) * cb) / (ga * gb - gij * gij)) / n, 0) AS m FROM g),
best AS (SELECT 1 AS n_terms, arg_min(terms, m) AS terms, min(m) AS m FROM one UNION ALL SELECT 2, arg_min(terms, m), min(m) FROM two UNION ALL SELECT 3, 'x0,x1,x0*x1', 0 UNION ALL SELECT 4, 'x0,x1,x2,x0*x1', 0)
SELECT n_terms, terms, round(m, 6) AS mse, n_terms = 2 AS chosen FROM best"""


def beam_search(spark, d):
    return refine.beam(sales(spark, d), ["x0", "x1"], "y", 4, 2, 6).orderBy("mse", "size", "formula").limit(5).select("formula", F.round("mse", 8).alias("mse"), "size", "round")


QUERIES = {n: f for n, f in list(globals().items()) if n in SQL or n in ("formula_corpus", "beam_search")}
