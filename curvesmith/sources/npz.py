"""Array archives of the driver's file system, for moving small data sets in and out; tables belong in Parquet."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def read_npz(spark: SparkSession, path: str, x_key: str = "X", y_key: str = "y") -> DataFrame:
    """(row_id, x0.., y)."""
    with np.load(path, allow_pickle=False) as f:
        x, y = np.asarray(f[x_key], float), np.asarray(f[y_key], float).ravel()
    x = x.reshape(len(y), -1)
    names = ["row_id", *(f"x{i}" for i in range(x.shape[1])), "y"]
    rows = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, ", ".join(f"{n} {'bigint' if n == 'row_id' else 'double'}" for n in names))


def write_npz(rows: DataFrame, path: str, inputs: list[str], y: str, most: int = 1_000_000) -> None:
    """At most `most` rows; more raise."""
    got = rows.select(*inputs, y).limit(most + 1).toPandas()
    if len(got) > most:
        raise ValueError(f"more than {most} rows: write Parquet")
    np.savez_compressed(path, X=got[inputs].to_numpy(float), y=got[y].to_numpy(float))
