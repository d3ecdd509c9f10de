"""Calibration: binned isotonic maps and their lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bins(rows: DataFrame, score: str, label: str, n: int = 20) -> DataFrame:
    """(bin, lo, hi, n, positive, rate) of scores in [0, 1]."""
    b = F.least(F.floor(F.col(score) * n), F.lit(n - 1)).cast("int")
    out = rows.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).cast("long").alias("positive"))
    edge = lambda k: (F.col("bin") + k) / F.lit(float(n))
    return out.select("bin", edge(0).alias("lo"), edge(1).alias("hi"), "n", "positive", (F.col("positive") / F.col("n")).alias("rate"))


#: Rows of either kind that a calibration needs.
LEAST = 10


def isotonic(binned: list[tuple[int, int, int]]) -> dict[int, float]:
    """(bin, n, positive) in order to non-decreasing rates, by pooling neighbours that violate the order. None at all, so
    that scores stay as they are, if there are fewer than LEAST positive or negative rows."""
    positive, every = sum(p for _, _, p in binned), sum(n for _, n, _ in binned)
    if min(positive, every - positive) < LEAST:
        return {}
    pools: list[list] = []
    for b, n, p in sorted(binned):
        pools.append([n, p, [b]])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] > pools[-1][1] * pools[-2][0]:
            n2, p2, b2 = pools.pop()
            pools[-1][0] += n2
            pools[-1][1] += p2
            pools[-1][2] += b2
    return {b: p / n for n, p, ids in pools for b in ids}


def lookup(rows: DataFrame, score: str, rates: dict[int, float], n: int = 20) -> DataFrame:
    """Adds calibrated: the rate of the score's bin (a literal map: there are n bins), or the score itself."""
    if not rates:
        return rows.withColumn("calibrated", F.col(score))
    table = F.create_map(*[F.lit(x) for kv in sorted(rates.items()) for x in kv])
    b = F.greatest(F.least(F.floor(F.col(score) * n), F.lit(n - 1)), F.lit(0)).cast("int")
    return rows.withColumn("calibrated", F.coalesce(F.try_element_at(table, b), F.col(score)))
