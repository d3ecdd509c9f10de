"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, done_with


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) to (node, root): the smallest node that each node of an edge is linked to. Nothing is gathered on
    the driver but two sums a round; every round is written to the shared folder."""
    e = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(rounds):
        # large star: each node hands its larger neighbours to the smallest of its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: each node hands its smaller neighbours and itself to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        last, e = e, cut(small.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        done_with(last)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components: no end within the rounds given")
    stars = e.groupBy("a").agg(F.min("b").alias("root"))
    return stars.select(F.col("a").alias("node"), "root").unionByName(stars.select(F.col("root").alias("node"), "root").distinct())
