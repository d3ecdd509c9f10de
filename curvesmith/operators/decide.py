"""Decision rules, importance and reports as expressions and aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def soft_round(x: Column, sharpness: float = 5.0) -> Column:
    return x - F.sin(F.lit(2 * math.pi) * x) / F.lit(2 * math.pi * sharpness)


def rounding_loss(x: Column) -> Column:
    """Squared distance to the nearest whole number."""
    f = x - F.floor(x)
    d = F.least(f, F.lit(1.0) - f)
    return d * d


def hoyer(value: Column) -> Column:
    """Sparsity of a group's values: (sqrt(n) - L1 / L2) / (sqrt(n) - 1 + 1e-8)."""
    n = F.sqrt(F.count(value).cast("double"))
    ratio = F.sum(F.abs(value)) / F.nullif(F.sqrt(F.sum(value * value)), F.lit(0.0))
    return (n - ratio) / (n - F.lit(1.0) + F.lit(1e-8))


def risk_seeking(rows: DataFrame, keys: list[str], fitness: str, percentile: float = 0.25, temperature: float = 1.0) -> DataFrame:
    """Adds p: softmax of (percentile - fitness) / temperature within the group."""
    cutoff = rows.groupBy(*keys).agg(F.percentile(fitness, percentile).alias("_cut"), F.min(fitness).alias("_low"))
    placed = rows.join(cutoff, keys)
    e = F.exp((F.col("_low") - F.col(fitness)) / F.lit(temperature))  # the percentile cancels; the least keeps it finite
    w = Window.partitionBy(*keys)
    return placed.withColumn("p", e / F.sum(e).over(w)).withColumn("threshold", F.col("_cut")).drop("_cut", "_low")


def ablation(rows: DataFrame, terms: dict[str, Column], weights: dict[str, float], y: str) -> DataFrame:
    """(term, mse_without, importance, level) of a linear formula: one aggregate with an error for each dropped term."""
    full = F.lit(0.0)
    for k, c in terms.items():
        full = full + F.lit(float(weights[k])) * c
    err = lambda p: F.avg((p - F.col(y)) * (p - F.col(y)))
    one = rows.agg(err(full).alias("base"), *[err(full - F.lit(float(weights[k])) * c).alias(f"m{i}") for i, (k, c) in enumerate(terms.items())])
    long = one.select("base", F.explode(F.array(*[F.struct(F.lit(k).alias("term"), F.col(f"m{i}").alias("mse_without")) for i, k in enumerate(terms)])).alias("t")).select("base", "t.*")
    gain = F.when(F.col("base") <= 1e-10, F.col("mse_without")).otherwise((F.col("mse_without") - F.col("base")) / F.greatest(F.col("base"), F.lit(1e-300)))
    out = long.withColumn("importance", gain)
    return out.withColumn("level", F.when(F.col("importance") > 1, "critical").when(F.col("importance") > 0.1, "important").otherwise("minor")).drop("base")


def failure_bucket(formula: Column, r2: Column, mse: Column, truth: Column) -> Column:
    """The first rule that explains a miss. Powers are read as ^ or **; the largest of each formula are compared, and a
    formula without any counts as of power 1."""
    found, want = F.lower(F.coalesce(formula, F.lit(""))), F.lower(F.coalesce(truth, F.lit("")))
    power = lambda c: F.array_max(F.transform(F.regexp_extract_all(c, F.lit(r"(?:\*\*|\^)\s*(\d{1,9})"), F.lit(1)), lambda k: k.cast("int")))
    wave = lambda c: F.contains(c, F.lit("sin(")) | F.contains(c, F.lit("cos("))
    has = lambda c, p: F.contains(c, F.lit(p))
    return (
        F.when(found == "", "no_formula")
        .when(has(want, "exp(-") & has(found, "exp(") & ~has(found, "exp(-"), "exp_sign_error")
        .when(has(want, "/") & ~has(found, "/"), "rational_denominator_missing")
        .when((power(want) >= 3) & (F.coalesce(power(found), F.lit(1)) < power(want)), "missing_high_order_terms")
        .when(wave(want) & ~wave(found), "periodic_structure_missing")
        .when(r2 >= 0.8, "near_miss_structural").when((mse > 1.0) & ~F.isnan(mse) & (mse < float("inf")), "high_error_instability").otherwise("other_structural_failure")
    )


def seed_summary(runs: DataFrame, key: str) -> DataFrame:
    """Per problem over its seeds (r2, mse, seconds, size, exact): median quality, exact share, time to the first exact
    and to the first acceptable result."""
    ok = (F.col("r2") >= 0.99) & (F.col("size") <= 20)
    return runs.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), F.median("r2").alias("r2_median"), F.count_if(F.col("exact")).alias("n_exact"),
        F.min(F.when(F.col("exact"), F.col("seconds"))).alias("first_exact_s"), F.min(F.when(ok, F.col("seconds"))).alias("first_acceptable_s"),
        F.stddev_pop("r2").alias("r2_sd"),
    )


def restart(rows: DataFrame, keys: list[str], pos: str, best: str, window: int = 40, least: float = 0.01) -> DataFrame:
    """Adds restart: whether the best improved by less than a share of `least` over the last `window` places."""
    w = Window.partitionBy(*keys).orderBy(pos)
    old = F.lag(best, window - 1).over(w)
    return rows.withColumn("restart", old.isNotNull() & ((old - F.col(best)) < F.lit(least) * F.abs(old)))


def stuck(rows: DataFrame, keys: list[str], pos: str, value: str, window: int = 10, least: float = 1.0) -> DataFrame:
    """Adds stuck: whether the means of the window's two halves differ by less than `least`."""
    w = Window.partitionBy(*keys).orderBy(pos)
    h = window // 2
    first, second = F.avg(value).over(w.rowsBetween(-(window - 1), -h)), F.avg(value).over(w.rowsBetween(-(h - 1), 0))
    n = F.count(F.lit(1)).over(w.rowsBetween(-(window - 1), 0))
    return rows.withColumn("stuck", (n == window) & F.coalesce(F.abs(first - second) < least, F.lit(False)))


def exploding(rows: DataFrame, keys: list[str], pos: str, value: str, window: int = 9, times: float = 3.0) -> DataFrame:
    """Adds exploding: whether a value is over `times` the median of the window up to it (five values at least)."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(window - 1), 0)
    held = F.sort_array(F.collect_list(value).over(w))  # `window` values at most
    n = F.size("_held")
    mid = (F.element_at("_held", F.floor((n + 1) / 2).cast("int")) + F.element_at("_held", (F.floor(n / 2) + 1).cast("int"))) / F.lit(2.0)
    out = rows.withColumn("_held", held)
    return out.withColumn("exploding", (n >= 5) & (F.col(value) > F.lit(times) * mid)).drop("_held")


def classifier_scores(rows: DataFrame, name: str, label: str, predicted: str) -> DataFrame:
    """Per class: tp, fp, fn and F1; the last row (null class) has the sums and the micro F1."""
    on = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t, p = F.col(label) == 1, F.col(predicted) == 1
    g = rows.rollup(name).agg(on(t & p).alias("tp"), on(~t & p).alias("fp"), on(t & ~p).alias("fn"))
    return g.withColumn("f1", F.coalesce(2 * F.col("tp") / F.nullif((2 * F.col("tp") + F.col("fp") + F.col("fn")).cast("double"), F.lit(0.0)), F.lit(0.0)))


def op_cdf(rows: DataFrame, name: str, prior: str) -> DataFrame:
    """Adds cdf over names in order: what a uniform draw is looked up in."""
    every = Window.partitionBy(F.lit(1))
    return rows.withColumn("cdf", F.sum(prior).over(every.orderBy(name)) / F.sum(prior).over(every))


def payload_errors(rows: DataFrame, payload: str) -> DataFrame:
    """Adds errors: why an interchange payload (JSON text) is not a valid one, in order of its fields. A skeleton's
    formula that is null counts as missing."""
    v = F.try_parse_json(payload)
    kind = lambda path: F.coalesce(F.schema_of_variant(F.try_variant_get(v, path, "variant")), F.lit("VOID"))
    is_map = lambda path: kind(path).startswith("OBJECT")
    note = lambda bad, text: F.when(bad, F.array(F.lit(text))).otherwise(F.array().cast("array<string>"))
    keys = F.coalesce(F.json_object_keys(F.to_json(F.when(is_map("$.routing_signal"), F.try_variant_get(v, "$.routing_signal", "variant")))), F.array().cast("array<string>"))
    skeletons = F.try_variant_get(v, "$.candidate_skeletons", "array<variant>")
    formula = lambda c: F.trim(F.coalesce(F.try_variant_get(c, "$.formula", "string"), F.lit("")))
    nameless = F.filter(F.transform(skeletons, lambda c, i: F.when(formula(c) == "", F.concat(F.lit("candidate_skeletons["), i.cast("string"), F.lit("] must include formula")))), lambda e: e.isNotNull())
    found = F.concat(
        note(F.coalesce(F.try_variant_get(v, "$.schema_version", "string"), F.lit("")) != "fpip.v2", "schema_version must be 'fpip.v2'"),
        F.when(F.coalesce(F.size(skeletons), F.lit(0)) < 1, F.array(F.lit("candidate_skeletons must be a non-empty list"))).otherwise(nameless),
        note(~is_map("$.sequence_uncertainty"), "sequence_uncertainty must be a dict"), note(~is_map("$.operator_priors"), "operator_priors must be a dict"),
        F.when(is_map("$.routing_signal"), F.concat(*[note(~F.array_contains(keys, k), f"routing_signal.{k} is required") for k in ("recommend_guided_evolution", "reason")])).otherwise(F.array(F.lit("routing_signal must be a dict"))),
    )
    whole = F.coalesce(F.schema_of_variant(v), F.lit("VOID")).startswith("OBJECT")
    return rows.withColumn("errors", F.when(whole, found).otherwise(F.array(F.lit("payload must be a dict"))))
