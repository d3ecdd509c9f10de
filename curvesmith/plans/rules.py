"""Queries over routing, budgets, acceptance and the search's schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.safe import rounded as r
from ..operators import routing
from ..sources.tables import sales, table
from .fitting import S, rd

SQL: dict[str, str] = {}


def _fits(spark, d):
    """Orders as fits: every figure from the key, with nulls and NaN among them."""
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", (k % 29 == 0).alias("only"), (k % 11 != 0).alias("enabled"), (k % 13 != 0).alias("applied"),
        F.when(k % 17 == 0, F.lit(float("nan"))).when(k % 23 != 0, F.lit(1.5) * F.pow(F.lit(10.0), -(k % 15).cast("double"))).alias("mse"), (k % 14).cast("int").alias("terms"),
        F.when(k % 7 != 0, (k % 10) / F.lit(10.0)).alias("entropy"), ((k % 9) / F.lit(30.0)).alias("margin"), (k % 19 == 0).alias("uncertain"), (k % 5 == 0).alias("suspicious"),
        (F.lit(1.0) - F.pow(F.lit(10.0), -(k % 4).cast("double")) * 0.7).alias("r2"), (k % 4 + 1).alias("features"), (k * 3).alias("samples"), (k % 3 == 0).alias("seeded"),
    )


F_SQL = """SELECT o_orderkey, k % 29 = 0 AS only_search, k % 11 <> 0 AS enabled, k % 13 <> 0 AS applied, CASE WHEN k % 17 = 0 THEN NULL WHEN k % 23 <> 0 THEN 1.5::DOUBLE * pow(10.0::DOUBLE, -(k % 15)) END AS mse,
  (k % 14)::INT AS terms, CASE WHEN k % 7 <> 0 THEN (k % 10) / 10.0::DOUBLE END AS entropy, (k % 9) / 30.0::DOUBLE AS margin, k % 19 = 0 AS uncertain, k % 5 = 0 AS suspicious,
  1.0::DOUBLE - pow(10.0::DOUBLE, -(k % 4)) * 0.7 AS r2, k % 4 + 1 AS features, k * 3 AS samples, k % 3 = 0 AS seeded FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)"""


def routing_reason(spark, d):
    """Why each fit goes on to the guided search or not, whether it does, and the seconds that it gets."""
    f = _fits(spark, d)
    c = {n: F.col(n) for n in f.columns}
    reason = routing.guided_reason(c["only"], c["enabled"], c["applied"], c["mse"], c["terms"], c["entropy"], c["margin"], c["uncertain"], c["suspicious"])
    budget = routing.compute_budget(c["samples"], c["features"], c["r2"], c["terms"], c["entropy"], c["margin"], c["uncertain"], c["seeded"])
    return f.select("o_orderkey", reason.alias("reason"), r(budget, 4).alias("budget_s")).withColumn("search", F.col("reason").isin(*routing.SEARCHED))


SQL["routing_reason"] = f"""
WITH f AS ({F_SQL}), g AS (SELECT *, CASE WHEN only_search THEN 'evolution_only' WHEN NOT enabled THEN 'disabled' WHEN NOT applied THEN 'fast_path_not_applicable' WHEN mse IS NULL THEN 'invalid_mse' WHEN mse < 1e-12 THEN 'fast_path_exact_zero'
  WHEN entropy < 0.3 AND mse < 1e-7 AND terms <= 6 THEN 'fast_path_confident_exact' WHEN mse >= 1e-6 THEN 'mse_above_exact' WHEN terms > 10 THEN 'formula_too_complex' WHEN uncertain THEN 'prediction_uncertain'
  WHEN entropy > 0.85 THEN 'high_entropy' WHEN margin < 0.1 THEN 'low_margin' WHEN suspicious THEN 'suspicious_residual' ELSE 'fast_path_confident' END AS reason,
  60.0::DOUBLE * ((1.0::DOUBLE + 0.15 * greatest(features - 1, 0) + 0.08::DOUBLE * least(log10(greatest(samples, 50)) / 3.0::DOUBLE, 1.0))
   * CASE WHEN r2 >= 0.995 AND terms <= 5 THEN 0.2::DOUBLE WHEN r2 >= 0.98 AND terms <= 8 THEN 0.5::DOUBLE WHEN r2 >= 0.9 THEN 0.9::DOUBLE ELSE 2.5::DOUBLE END
   * CASE WHEN uncertain THEN 1.2::DOUBLE WHEN entropy IS NOT NULL THEN 1.0::DOUBLE - 0.9::DOUBLE * least(greatest((1.0::DOUBLE - entropy) * least(margin / 0.25::DOUBLE, 1.0), 0.0), 1.0) ELSE 1.0::DOUBLE END * CASE WHEN seeded THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END) AS b FROM f)
SELECT o_orderkey, reason, {rd('least(greatest(b, 10.0::DOUBLE), 300.0::DOUBLE)')} AS budget_s,
  reason NOT IN ('disabled', 'fast_path_exact_zero', 'fast_path_confident_exact', 'fast_path_confident') AS search FROM g"""


def acceptance(spark, d):
    """Gate, need of a search and acceptance of a refined candidate, for each fit."""
    f = _fits(spark, d)
    old = F.pow(F.lit(10.0), -(F.col("o_orderkey") % 8).cast("double"))
    new_score, old_score = F.col("mse") + F.lit(0.001) * F.col("terms"), old + F.lit(0.001) * (F.lit(13) - F.col("terms"))
    predictions = F.create_map(F.lit("sin"), F.col("entropy"), F.lit("power"), F.col("margin") * 2.2)
    return f.select(
        "o_orderkey", routing.fast_path_gate(predictions).alias("gate"),
        routing.need_search(F.when(F.col("applied"), F.lit("x")), F.col("mse"), F.col("r2"), F.col("enabled"), F.col("terms"), bloated=12).alias("need"),
        routing.accepted(F.col("mse"), F.col("terms"), new_score, old, F.lit(13) - F.col("terms"), old_score).alias("accepted"),
        routing.in_subset(F.col("terms"), F.concat(F.lit("Nguyen-"), F.col("o_orderkey").cast("string")), tiers=[1, 2, 5], part="nguyen-1").alias("chosen"),
    )


SQL["acceptance"] = f"""
WITH f AS (SELECT *, pow(10.0::DOUBLE, -(o_orderkey % 8)) AS old FROM ({F_SQL}))
SELECT o_orderkey, coalesce(entropy >= 0.6, false) OR coalesce(margin * 2.2::DOUBLE >= 0.6, false) AS gate,
  CASE WHEN applied AND terms > 12 THEN false ELSE NOT applied OR mse IS NULL OR r2 < 0.999 OR NOT enabled OR terms > 10 END AS need,
  coalesce(NOT (old <= 1e-5 AND mse > old * 5.0::DOUBLE AND NOT (mse < 1e-6 AND terms <= 5 AND 13 - terms > 5)) AND mse + 0.001::DOUBLE * terms < old + 0.001::DOUBLE * (13 - terms), false) AS accepted,
  terms IN (1, 2, 5) AND starts_with(o_orderkey::VARCHAR, '1') AS chosen FROM f"""


def _steps(spark, d):
    """Events as generations of a run for each user."""
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    v = F.col("value") / F.lit(500.0)
    return e.select("user_id", "event_id", (F.lit(1.0) - v * v / 8.0).alias("corr"), (v * v / 50.0).alias("mse"), (F.lit(1.0) - v / 10.0).alias("val"))


E_SQL = "SELECT user_id, event_id, 1.0::DOUBLE - v * v / 8.0::DOUBLE AS corr, v * v / 50.0::DOUBLE AS mse, 1.0::DOUBLE - v / 10.0::DOUBLE AS val FROM (SELECT user_id, event_id, value / 500.0::DOUBLE AS v FROM events)"


def structure_confidence(spark, d):
    """Confidence in a run's structure, the mutation rate that follows, and what is left of it after a refinement."""
    out = routing.structure_confidence(_steps(spark, d), ["user_id"], "event_id", "corr", "mse", "val")
    rate = routing.mutation_rate(F.lit(0.3), F.col("confidence"))
    left = routing.after_refinement(F.col("confidence"), F.col("mse"), F.lit(0.012))
    return out.select("user_id", "event_id", "stable", r(F.col("confidence"), 6).alias("confidence"), r(rate, 6).alias("rate"), r(left, 6).alias("left_after"))


SQL["structure_confidence"] = f"""
WITH s AS (SELECT *, CASE WHEN corr > 0.995 AND mse < 0.01 THEN 1 ELSE -1 END AS step FROM ({E_SQL})),
c AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY event_id) AS total FROM s),
t AS (SELECT *, (total - least(min(total) OVER (PARTITION BY user_id ORDER BY event_id), 0))::BIGINT AS stable FROM c),
b AS (SELECT *, coalesce(lag(stable) OVER (PARTITION BY user_id ORDER BY event_id), 0) AS before FROM t),
k AS (SELECT *, least(0.5::DOUBLE * CASE WHEN corr < 0.95 THEN 0.0::DOUBLE WHEN corr >= 0.995 THEN 1.0::DOUBLE ELSE (corr - 0.95::DOUBLE) / {0.995 - 0.95!r}::DOUBLE END
  + 0.25::DOUBLE * CASE WHEN mse >= 0.1 THEN 0.0::DOUBLE WHEN mse <= 0.01 THEN 1.0::DOUBLE ELSE log10(0.1::DOUBLE / (mse + 1e-10)) END
  + 0.25::DOUBLE * least(before / 5.0::DOUBLE, 1.0) + CASE WHEN val > 0.98 THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END, 1.0) AS confidence FROM b)
SELECT user_id, event_id, stable, {rd('confidence', 6)} AS confidence, {rd('0.3::DOUBLE * (1.0::DOUBLE - confidence * 0.9::DOUBLE)', 6)} AS rate,
  {rd('CASE WHEN (mse - 0.012::DOUBLE) / (mse + 1e-10) < -0.2 THEN confidence * 0.5::DOUBLE ELSE confidence END', 6)} AS left_after FROM k"""


def sensitivity_profile(spark, d):
    p = table(spark, d, "part")
    got = routing.sensitivity_profile(F.col("p_retailprice") / F.lit(1500.0), F.col("p_size") / F.lit(50.0))
    return p.select("p_partkey", r(got["rate"], 6).alias("rate"), r(got["noise"], 6).alias("noise"), got["freeze"].alias("freeze"))


SQL["sensitivity_profile"] = f"""
WITH p AS (SELECT p_partkey, least(greatest(p_retailprice / 1500.0::DOUBLE, 0.0), 1.0)::DOUBLE AS s, p_size / 50.0::DOUBLE AS rate FROM part)
SELECT p_partkey, {rd('greatest(least(rate * (1.0::DOUBLE - 0.5::DOUBLE * s), 1.0), 0.05::DOUBLE * rate)', 6)} AS rate, {rd('0.5::DOUBLE * (1.0::DOUBLE + (1.0::DOUBLE - s) * 0.5::DOUBLE)', 6)} AS noise, s >= 0.85 AS freeze FROM p"""


def activation_cooldown(spark, d):
    """Places at which a run's risk-seeking mode is on: after a jump of the error, until five calm places."""
    out = routing.activation(_steps(spark, d), ["user_id"], "event_id", F.col("mse") > 0.06, 10, 5)
    return out.groupBy("user_id").agg(F.count_if("active").alias("n_active"), F.min(F.when(F.col("active"), F.col("event_id"))).alias("first"))


SQL["activation_cooldown"] = f"""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM ({E_SQL})),
h AS (SELECT *, max(CASE WHEN mse > 0.06 AND n >= 10 THEN n END) OVER (PARTITION BY user_id ORDER BY event_id) AS hit FROM n)
SELECT user_id, count(*) FILTER (n - hit < 5) AS n_active, min(event_id) FILTER (n - hit < 5) AS first FROM h GROUP BY 1"""


def gradient_importance(spark, d):
    terms = {"x0": F.col("x0"), "x0*x1": F.col("x0") * F.col("x1"), "x2": F.col("x2")}
    out = routing.gradient_importance(sales(spark, d), terms, {"x0": 0.9, "x0*x1": -1.0, "x2": 0.00001}, "y")
    return out.select("term", r(F.col("importance"), 4).alias("importance"), "dead")


SQL["gradient_importance"] = f"""
WITH e AS (SELECT *, 0.9::DOUBLE * x0 - x0 * x1 + 0.00001::DOUBLE * x2 - y AS e FROM ({S})), g AS (SELECT avg(x0 * e) AS a, avg(x0 * x1 * e) AS b, avg(x2 * e) AS c FROM e),
t AS (SELECT unnest(['x0', 'x0*x1', 'x2']) AS term, unnest([abs(0.9::DOUBLE * 2 * a), abs(2 * b), abs(0.00001::DOUBLE * 2 * c)]) AS i FROM g)
SELECT term, {rd('i')} AS importance, i <= 0.01 AS dead FROM t"""


def skeleton_ranking(spark, d):
    """Events of each type by user as decoded skeletons: the five best by prior and fit."""
    e = table(spark, d, "events").groupBy("event_type", "user_id").agg((F.count(F.lit(1)) / F.lit(200.0)).alias("prior"), F.avg("value").alias("mse"))
    out = routing.skeleton_rank(e.withColumn("variance", F.lit(150.0)), ["event_type"], "prior", "mse", "variance", "user_id").filter("rank <= 5")
    return out.select("event_type", "rank", r(F.col("score"), 6).alias("score"))


SQL["skeleton_ranking"] = f"""
WITH e AS (SELECT event_type, user_id, 0.65::DOUBLE * (count(*) / 200.0::DOUBLE) + 0.35::DOUBLE * exp(-avg(value) / 150.0::DOUBLE) AS score FROM events GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, user_id)::INT AS rank FROM e)
SELECT event_type, rank, {rd('score', 6)} AS score FROM k WHERE rank <= 5"""


def interpolated_hours(spark, d):
    """Each type's mean value by hour, read off between the even hours, flat beyond them."""
    e = table(spark, d, "events").groupBy("event_type", F.hour("ts").cast("double").alias("x")).agg(F.avg("value").alias("y"))
    points = e.select("event_type", F.col("x")).distinct().select("event_type", (F.col("x") + 0.25).alias("x"))
    out = routing.interpolated(points, e.filter("x % 2 = 0"), ["event_type"], "x", "y")
    return out.select("event_type", "x", r(F.col("y"), 4).alias("y"))


SQL["interpolated_hours"] = f"""
WITH e AS (SELECT event_type, hour(ts)::DOUBLE AS x, avg(value) AS y FROM events GROUP BY 1, 2), k AS (SELECT *, lead(x) OVER w AS nx, lead(y) OVER w AS ny FROM e WHERE x % 2 = 0 WINDOW w AS (PARTITION BY event_type ORDER BY x)),
p AS (SELECT DISTINCT event_type, x + 0.25::DOUBLE AS x FROM e), f AS (SELECT event_type, arg_min(y, x) AS first FROM k GROUP BY 1)
SELECT p.event_type, p.x, {rd('coalesce(k.y + coalesce((k.ny - k.y) / (k.nx - k.x), 0.0) * (p.x - k.x), f.first)')} AS y
FROM p ASOF LEFT JOIN k ON p.event_type = k.event_type AND p.x >= k.x LEFT JOIN f ON p.event_type = f.event_type"""


def feature_moments(spark, d):
    """Mean and population deviation of every feature, what a classifier's inputs are standardised by: one aggregate."""
    x = {"quantity": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    one = table(spark, d, "lineitem").agg(F.array(*[F.struct(F.lit(k).alias("feature"), F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(1e-8)).alias("sd")) for k, c in x.items()]).alias("f"))
    return one.select(F.explode("f").alias("f")).select("f.feature", r(F.col("f.mean"), 4).alias("mean"), r(F.col("f.sd"), 4).alias("sd"))


SQL["feature_moments"] = f"""
SELECT feature, {rd('avg(v)')} AS mean, {rd('greatest(stddev_pop(v), 1e-8)')} AS sd FROM (SELECT unnest(['quantity', 'price', 'discount', 'tax']) AS feature, unnest([l_quantity, l_extendedprice, l_discount, l_tax]::DOUBLE[]) AS v FROM lineitem) GROUP BY 1"""

QUERIES = {n: f for n, f in list(globals().items()) if n in SQL}
