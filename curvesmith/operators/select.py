"""Choosing among candidates: dominance, crowding, duplicates, top k."""

from __future__ import annotations

from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


#: Shares of the rows whose fronts are found before that of all.
SHARES = 256


def pareto_front(rows: DataFrame, a: str, b: str, keys: list[str] | None = None) -> DataFrame:
    """Rows that no other beats in both a and b (smaller is better, strictly in one). Sorted by (a, b), a row is on the
    front iff its b is below all b of smaller a, and the least of its own a: a running minimum instead of a join of
    all pairs. That is done in shares of the rows first, so what one task sorts in the end are the few rows of their
    fronts, whatever the table."""
    best = rows.groupBy(*(keys or []), a).agg(F.min(b).alias("_own"))
    share = Window.partitionBy(*(keys or []), F.pmod(F.xxhash64(a), F.lit(SHARES)))
    lead = F.min("_own").over(share.orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_lead", lead).filter(F.col("_lead").isNull() | (F.col("_own") < F.col("_lead"))).drop("_lead")
    w = Window.partitionBy(*(keys or [F.lit(1)]))
    before = F.min("_own").over(w.orderBy(a).rowsBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_before", before).filter(F.col("_before").isNull() | (F.col("_own") < F.col("_before")))
    return rows.join(best.drop("_before"), [*(keys or []), a]).filter(F.col(b) == F.col("_own")).drop("_own")


def ranks(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Adds rank to all rows: 0 for the front, 1 for the front of the rest, and so on to the last; null where a or b is
    null or NaN. A pair's front is one more than the last front that dominates it. In order of (a, b) all that dominate a
    pair come before it, so one sweep over the distinct pairs finds it in the least b of each front, which ascend: the
    sweep is one sorted stream of two columns and holds one number a front."""
    has = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in (a, b)]
    pairs = rows.filter(has[0] & has[1]).select(a, b).distinct().repartition(1).sortWithinPartitions(a, b)

    def sweep(batches):
        least = []
        for batch in batches:
            found = []
            for v in batch.column(1).to_pylist():
                k = bisect_right(least, v)
                least[k : k + 1] = [v]
                found.append(k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int32())], names=[a, b, "rank"])

    ranked = pairs.mapInArrow(sweep, T.StructType([*pairs.schema.fields, T.StructField("rank", T.IntegerType())]))
    return rows.join(ranked, [a, b], "left")


def crowding(rows: DataFrame, objectives: list[str], keys: list[str], tie: list[str]) -> DataFrame:
    """Adds crowding: the sum over objectives of the gap between a row's neighbours over the range; ends get 1e18."""
    w = Window.partitionBy(*keys)
    total = F.lit(0.0)
    for o in objectives:
        s = w.orderBy(o, *tie)
        gap = F.lead(o).over(s) - F.lag(o).over(s)
        span = F.max(o).over(w) - F.min(o).over(w)
        end = F.lag(o).over(s).isNull() | F.lead(o).over(s).isNull()
        total = total + F.when(end, F.lit(1e18)).otherwise(F.coalesce(gap / F.nullif(span, F.lit(0.0)), F.lit(0.0)))
    return rows.withColumn("crowding", F.least(total, F.lit(1e18)))


def best_of_each(rows: DataFrame, signature: str, score: str, tie: str) -> DataFrame:
    """One row a signature, of the least score: a partial aggregate, not a window."""
    others = [c for c in rows.columns if c not in (signature, score, tie)]
    m = F.min(F.struct(score, tie, *others)).alias("m")
    return rows.groupBy(signature).agg(m).select(signature, "m.*")


def top_k(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group (Spark cuts groups to k before it shuffles them)."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def elites(rows: DataFrame, k: int) -> DataFrame:
    """The k best by rank, then by crowding, then by id."""
    return rows.orderBy("rank", F.desc("crowding"), "id").limit(k)
