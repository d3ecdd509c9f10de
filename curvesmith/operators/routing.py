"""What happens next to a fit: gates, routing, budgets and acceptance as expressions over its figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.safe import is_finite


def sure(c: Column) -> Column:
    """A condition that is false where it is unknown."""
    return F.coalesce(c, F.lit(False))


#: Reasons that send a fit to the search; all others keep it.
SEARCHED = (
    "evolution_only", "fast_path_not_applicable", "invalid_mse", "mse_above_exact", "formula_too_complex", "prediction_uncertain",
    "high_entropy", "low_margin", "suspicious_residual",
)


def guided_reason(only: Column, enabled: Column, applied: Column, mse: Column, terms: Column, entropy: Column, margin: Column, uncertain: Column, suspicious: Column) -> Column:
    """The first rule that decides whether a fit goes on to the guided search. Figures that are null or not finite
    decide nothing."""
    h, m = F.when(is_finite(entropy), entropy), F.when(is_finite(margin), margin)
    return (
        F.when(sure(only), "evolution_only").when(~sure(enabled), "disabled").when(~sure(applied), "fast_path_not_applicable")
        .when(~is_finite(mse), "invalid_mse").when(mse < 1e-12, "fast_path_exact_zero")
        .when(sure(h < 0.3) & (mse < 1e-7) & (terms <= 6), "fast_path_confident_exact")
        .when(mse >= 1e-6, "mse_above_exact").when(terms > 10, "formula_too_complex").when(sure(uncertain), "prediction_uncertain")
        .when(sure(h > 0.85), "high_entropy").when(sure(m < 0.1), "low_margin").when(sure(suspicious), "suspicious_residual").otherwise("fast_path_confident")
    )


def compute_budget(samples: Column, features: Column, r2: Column, terms: Column, entropy: Column, margin: Column, uncertain: Column, seeded: Column, base: float = 60.0, least: float = 10.0, most: float = 300.0) -> Column:
    """Seconds for the search: the base times a score that grows with the data's size, shrinks with the quality of the
    fit and with certainty, and with skeletons to start from; within bounds."""
    size = F.lit(1.0) + F.lit(0.15) * F.greatest(features - 1, F.lit(0)) + F.lit(0.08) * F.least(F.log10(F.greatest(samples, F.lit(50)).cast("double")) / 3.0, F.lit(1.0))
    fit = F.when((r2 >= 0.995) & (terms <= 5), 0.2).when((r2 >= 0.98) & (terms <= 8), 0.5).when(r2 >= 0.90, 0.9).otherwise(2.5)
    confidence = F.least(F.greatest((F.lit(1.0) - entropy) * F.least(margin / 0.25, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    known = is_finite(entropy) & is_finite(margin)
    doubt = F.when(sure(uncertain), 1.2).when(known, F.lit(1.0) - F.lit(0.9) * confidence).otherwise(1.0)
    score = size * fit * doubt * F.when(sure(seeded), 0.7).otherwise(1.0)
    return F.least(F.greatest(F.lit(base) * score, F.lit(least)), F.lit(most))


def need_search(formula: Column, mse: Column, r2: Column, folds_ok: Column, terms: Column, enough_r2: float = 0.999, bloated: int | None = None) -> Column:
    """Whether an estimator's fit is to be searched on; with `bloated`, formulas of more terms are kept as they are."""
    need = formula.isNull() | ~is_finite(mse) | sure(r2 < enough_r2) | r2.isNull() | ~sure(folds_ok) | sure(terms > 10)
    return need if bloated is None else F.when(formula.isNotNull() & sure(terms > bloated), F.lit(False)).otherwise(need)


def accepted(new_mse: Column, new_terms: Column, new_score: Column, old_mse: Column, old_terms: Column, old_score: Column) -> Column:
    """Whether a refined candidate replaces the best: a better score, and beside a fit that is good already no error five
    times as large, unless it is exact and crosses from more than five terms to five or fewer."""
    worse = (old_mse <= 1e-5) & (new_mse > old_mse * 5.0)
    simpler = (new_mse < 1e-6) & (new_terms <= 5) & (old_terms > 5)
    return sure(~(worse & ~simpler) & (new_score < old_score))


def fast_path_gate(predictions: Column, confidence: float = 0.6, least: int = 1) -> Column:
    """Whether at least `least` operators of a map (operator, probability) are likely enough."""
    return F.size(F.filter(F.map_values(predictions), lambda p: sure(p >= confidence))) >= least


def in_subset(tier: Column, name: Column, tiers: list | None = None, names: list[str] | None = None, part: str | None = None) -> Column:
    """Whether a problem is among the tiers and names asked for, and its name holds `part`."""
    ok = F.lit(True)
    if tiers:
        ok = ok & tier.isin(*tiers)
    if names:
        ok = ok & name.isin(*names)
    return ok & F.contains(F.lower(name), F.lit(part.lower())) if part else ok


def skeleton_rank(rows: DataFrame, keys: list[str], prior: str, mse: str, variance: str, name: str) -> DataFrame:
    """Adds score (0.65 of the prior and 0.35 of how well the skeleton fits) and rank of decoded skeletons."""
    fit = F.exp(-F.col(mse) / F.greatest(F.col(variance), F.lit(1e-12)))
    out = rows.withColumn("score", F.lit(0.65) * F.col(prior) + F.lit(0.35) * F.coalesce(fit, F.lit(0.0)))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), name)))


# ---------------------------------------------------------------- schedules of the search


def counted_up_and_down(rows: DataFrame, keys: list[str], pos: str, up: Column) -> DataFrame:
    """Adds stable: a counter that goes up by one where `up` holds and else down by one, but not below 0. It is the sum
    of steps less the least sum so far, so it needs no loop."""
    w = Window.partitionBy(*keys).orderBy(pos)
    out = rows.withColumn("_sum", F.sum(F.when(sure(up), 1).otherwise(-1)).over(w))
    return out.withColumn("stable", F.col("_sum") - F.least(F.min("_sum").over(w), F.lit(0))).drop("_sum")


def structure_confidence(rows: DataFrame, keys: list[str], pos: str, corr: str, mse: str, val_corr: str, good: float = 0.01, low: float = 0.95, high: float = 0.995, generations: int = 5) -> DataFrame:
    """Adds stable and confidence: half of it from the correlation, a quarter each from the error (on a log scale over
    one decade) and from how many generations were good before this one; a tenth more if the held-out rows agree."""
    c, m = F.col(corr), F.col(mse)
    out = counted_up_and_down(rows, keys, pos, (c > high) & (m < good))
    w = Window.partitionBy(*keys).orderBy(pos)
    before = F.coalesce(F.lag("stable").over(w), F.lit(0))
    by_corr = F.when(c < low, 0.0).when(c >= high, 1.0).otherwise((c - low) / (high - low))
    by_mse = F.when(m >= good * 10, 0.0).when(m <= good, 1.0).otherwise(F.log10(F.lit(good * 10) / (m + 1e-10)))
    by_time = F.least(before / F.lit(float(generations)), F.lit(1.0))
    bonus = F.when(sure(F.col(val_corr) > 0.98), 0.1).otherwise(0.0)
    return out.withColumn("confidence", F.least(F.lit(0.5) * by_corr + F.lit(0.25) * by_mse + F.lit(0.25) * by_time + bonus, F.lit(1.0)))


def mutation_rate(base: Column, confidence: Column, least: float = 0.1) -> Column:
    return base * (F.lit(1.0) - confidence * (1.0 - least))


def after_refinement(confidence: Column, before: Column, after: Column) -> Column:
    """Confidence after a refinement: halved if it made the error a fifth worse."""
    return F.when((before - after) / (before + 1e-10) < -0.2, confidence * 0.5).otherwise(confidence)


def sensitivity_profile(sensitivity: Column, rate: Column, bias: float = 0.5) -> dict[str, Column]:
    """Mutation rate, noise scale and freeze of a parameter by how much the error hangs on it."""
    s = F.least(F.greatest(sensitivity, F.lit(0.0)), F.lit(1.0))
    adjusted = F.greatest(F.least(rate * (F.lit(1.0) - F.lit(bias) * s), F.lit(1.0)), F.lit(0.05) * rate)
    return {"rate": adjusted, "noise": F.lit(0.5) * (F.lit(1.0) + (F.lit(1.0) - s) * bias), "freeze": s >= 0.85}


def activation(rows: DataFrame, keys: list[str], pos: str, trigger: Column, window: int, cooldown: int) -> DataFrame:
    """Adds active: on from a trigger until `cooldown` places in a row had none; never before `window` places are there."""
    w = Window.partitionBy(*keys).orderBy(pos)
    out = rows.withColumn("_n", F.row_number().over(w))
    hit = F.max(F.when(sure(trigger) & (F.col("_n") >= window), F.col("_n"))).over(w)
    return out.withColumn("active", sure(F.col("_n") - hit < cooldown)).drop("_n")


def gradient_importance(rows: DataFrame, terms: dict[str, Column], weights: dict[str, float], y: str) -> DataFrame:
    """(term, importance, dead) of a linear formula: |w * g| with g the gradient of the mean squared error, all terms in
    one aggregate; a term of at most 0.01 is dead."""
    full = F.lit(0.0)
    for k, c in terms.items():
        full = full + F.lit(float(weights[k])) * c
    one = rows.agg(*[(F.lit(2.0) * F.avg(c * (full - F.col(y)))).alias(f"g{i}") for i, c in enumerate(terms.values())])
    cells = [F.struct(F.lit(k).alias("term"), F.abs(F.lit(float(weights[k])) * F.col(f"g{i}")).alias("importance")) for i, k in enumerate(terms)]
    return one.select(F.explode(F.array(*cells)).alias("t")).select("t.term", "t.importance", (F.col("t.importance") <= 0.01).alias("dead"))


def interpolated(points: DataFrame, knots: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """points (keys, x) with y on the broken line through knots (keys, x, y), flat beyond its ends. Points and knots go
    through one window in order of x: the last knot before and the first one after are what a place needs."""
    both = knots.select(*keys, x, F.col(y).alias("_y"), F.lit(0).alias("_kind")).unionByName(points.select(*keys, x, F.lit(None).cast("double").alias("_y"), F.lit(1).alias("_kind")))
    w = Window.partitionBy(*keys).orderBy(x, "_kind")
    before, after = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    knot = F.when(F.col("_kind") == 0, F.struct(F.col(x).alias("x"), F.col("_y").alias("y")))
    out = both.withColumns({"_a": F.last(knot, True).over(before), "_b": F.first(knot, True).over(after)}).filter("_kind = 1")
    slope = (F.col("_b.y") - F.col("_a.y")) / F.nullif(F.col("_b.x") - F.col("_a.x"), F.lit(0.0))
    value = F.when(F.col("_a").isNull(), F.col("_b.y")).when(F.col("_b").isNull(), F.col("_a.y")).otherwise(F.coalesce(F.col("_a.y") + slope * (F.col(x) - F.col("_a.x")), F.col("_a.y")))
    return out.select(*keys, x, value.alias(y))


#: Fixed value: the lead of the likeliest operator that earns full trust.
FULL_MARGIN = 0.35


def prior_trust(entropy: Column, margin: Column, uncertain: Column) -> Column:
    """How far a classifier's priors are believed, from 0 to 1: the lesser of what its entropy and its margin allow (what is
    unknown allows all), half of that if it calls itself uncertain."""
    within = lambda v: F.when(is_finite(v), F.least(F.greatest(v, F.lit(0.0)), F.lit(1.0))).otherwise(1.0)
    least = F.least(within(F.lit(1.0) - entropy), within(margin / F.lit(FULL_MARGIN)))
    return least * F.when(sure(uncertain), 0.5).otherwise(1.0)


def blended_prior(prior: Column, trust: Column, n: Column) -> Column:
    """A share of n that sum to 1, drawn towards an even share by what trust lacks."""
    t = F.least(F.greatest(trust, F.lit(0.0)), F.lit(1.0))
    return t * prior + (F.lit(1.0) - t) / n
