"""Table scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with scaled inputs x0 (price), x1 (discount), x2 (quantity) and the planted target y = x0 - x0*x1."""
    x0, x1 = F.col("l_extendedprice") / F.lit(1000.0), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", x0.alias("x0"), x1.alias("x1"),
        (F.col("l_quantity") / F.lit(10.0)).alias("x2"), (x0 - x0 * x1).alias("y"),
    )
