"""Cutting lineage in iterative operators, dealing out narrow rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new place in the checkpoint folder: that of spark.checkpoint.dir or of the context, or one of our own where neither
    is set (tests)."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir")
    if not path:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="curvesmith-"))
        path = sc._jsc.sc().getCheckpointDir().get()
    return f"{path.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back as a table in the checkpoint folder. A table, as checkpoint() keeps what the optimizer
    inferred of df, and that multiplies from round to round."""
    path = folder(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def dealt(rows: DataFrame) -> DataFrame:
    """Narrow rows of long work each in shares for all cores, several a core: a file of a few MB is one task else."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
