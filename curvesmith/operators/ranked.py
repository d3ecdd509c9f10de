"""Values at given ranks of a few large groups, without sorting the groups: a histogram finds the bins that hold the ranks,
and only rows of those bins are sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import cut

BINS = 4096


def same(a: DataFrame, b: DataFrame, keys: list[str]):
    """Null-safe equality of the keys of two aliased tables a and b."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return out


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """a with the other columns of b (one row a group)."""
    more = [F.col(f"b.{c}") for c in b.columns if c not in keys]
    return a.alias("a").join(b.alias("b"), same(a, b, keys), how).select("a.*", *more)


def _held(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, _n, a struct for each rank): the value there (`at`) and how many values of the group are smaller (`less`).

    Three passes over the rows, none of which shuffles them: the span of each group, how many values fall into each of BINS
    parts of it (both combined before the shuffle), and the values of the parts that hold a rank, counted by value. What the
    first two find, a row and at most two parts a rank for each group, is stored, so nothing is computed twice."""
    own = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    span = cut(own.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    placed = joined(own, span, keys).withColumn("_bin", F.coalesce(F.floor((F.col("_v") - F.col("_lo")) / width * BINS), F.lit(0)))
    bins = placed.groupBy(*keys, "_bin", "_n").agg(F.count(F.lit(1)).alias("_c"))
    up = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_before", F.coalesce(F.sum("_c").over(up), F.lit(0)))
    holds = F.lit(False)
    for rank in ranks.values():
        holds = holds | ((rank > F.col("_before")) & (rank <= F.col("_before") + F.col("_c")))
    chosen = cut(bins.filter(holds).select(*keys, "_bin", "_before"))
    near = joined(placed, chosen, [*keys, "_bin"]).groupBy(*keys, "_bin", "_n", "_before", "_v").agg(F.count(F.lit(1)).alias("_c"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy("_v"))
    near = near.withColumn("_upto", upto)
    less = F.col("_upto") - F.col("_c")
    at = [F.max(F.when((rank <= F.col("_upto")) & (rank > less), F.struct(F.col("_v").alias("at"), less.alias("less")))).alias(name) for name, rank in ranks.items()]
    return near.groupBy(*keys, "_n").agg(*at)


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """(keys, _n, names): the values at the given ranks (from 1; expressions over _n, the group's number of values).
    Null values have no rank. Equal values are counted before they are ordered, so ties cost nothing."""
    return _held(rows, keys, value, ranks).select(*keys, "_n", *[F.col(f"{name}.at").alias(name) for name in ranks])


def quantile_ranks(shares: dict[str, float]) -> tuple[dict[str, Column], dict[str, Column]]:
    """Ranks that interpolated quantiles need, and the quantiles from the values there."""
    ranks, out = {}, {}
    for name, q in shares.items():
        p = (F.col("_n") - 1) * F.lit(q)
        ranks[f"_{name}_a"] = F.floor(p) + 1
        ranks[f"_{name}_b"] = F.ceil(p) + 1
        a, b = F.col(f"_{name}_a"), F.col(f"_{name}_b")
        out[name] = a + (p - F.floor(p)) * (b - a)
    return ranks, out


def ends(rows: DataFrame, keys: list[str], value: str, tie: list[str], k: Column) -> DataFrame:
    """Adds low and high: whether a row is among the first or last k (over _n) of its group in order of (value, tie). Rows
    beyond the values at those ranks are told by comparison; only rows that share one of them are sorted. A null value
    is at neither end."""
    n, v = F.col("_n"), F.col(value).cast("double")
    found = _held(rows, keys, value, {"_low": k, "_high": n - k + 1})
    # the rows above the value at the upper rank: those from it on, without those that share it
    cuts = cut(found.select(*keys, "_n", k.alias("_k"), F.col("_low.at").alias("_low"), F.col("_low.less").alias("_less"), F.col("_high.at").alias("_high"), F.col("_high.less").alias("_under")))
    placed = joined(rows, cuts, keys, "left")
    on = F.coalesce((v == F.col("_low")) | (v == F.col("_high")), F.lit(False))
    w = Window.partitionBy(*keys, v)
    ties = placed.filter(on).withColumn("_more", F.col("_n") - F.col("_under") - F.count(F.lit(1)).over(w))
    first, last = F.row_number().over(w.orderBy(*tie)), F.row_number().over(w.orderBy(*[F.desc(t) for t in tie]))
    ties = ties.withColumns({"_first": first, "_last": last})
    ties = ties.withColumn("low", (v < F.col("_low")) | ((v == F.col("_low")) & (F.col("_first") <= F.col("_k") - F.col("_less"))))
    ties = ties.withColumn("high", (v > F.col("_high")) | ((v == F.col("_high")) & (F.col("_last") <= F.col("_k") - F.col("_more"))))
    false = lambda c: F.coalesce(c, F.lit(False))
    clear = placed.filter(~on).withColumns({"low": false(v < F.col("_low")), "high": false(v > F.col("_high"))})
    own = [*rows.columns, "low", "high"]
    return clear.select(*own).unionByName(ties.select(*own))
