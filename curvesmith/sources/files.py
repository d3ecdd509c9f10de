"""Text scans, trace scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = (
    "run_id string, event string, generation int, best_fitness double, best_raw_mse double, best_complexity int, "
    "population array<struct<idx:int,fitness:double,raw_mse:double,complexity:int,nodes:int,age:int,formula:string>>"
)


def whitespace_text(spark: SparkSession, path: str, columns: int, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Numbers parted by white space, a row a line; the last is y. Lines with another count or another content are left
    out. sample: that many rows, the least by a digest of the line."""
    parts = F.filter(F.split(F.trim("value"), r"\s+"), lambda s: s != "")
    rows = spark.read.text(path).select("value", parts.alias("p")).filter(F.size("p") == columns)
    names = [*(f"x{i}" for i in range(columns - 1)), "y"]
    rows = rows.select("value", *[F.expr(f"try_cast(p[{i}] as double)").alias(n) for i, n in enumerate(names)])
    rows = rows.dropna(subset=names)
    if sample is not None:
        rows = rows.orderBy(F.xxhash64("value", F.lit(seed)), "value").limit(sample)
    return rows.drop("value")


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines (gzip or not); malformed ones are left out."""
    return spark.read.schema(TRACE).option("mode", "DROPMALFORMED").json(path)


def stream_trace(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(TRACE).option("maxFilesPerTrigger", files_per_trigger).json(path)


def write_trace(events: DataFrame, path: str, compression: str = "gzip") -> None:
    events.write.mode("append").option("compression", compression).json(path)


def write_dataset(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    w = rows.write.mode("append")
    (w.partitionBy(partition_by) if partition_by else w).parquet(path)


def markdown(rows: DataFrame, most: int = 200) -> str:
    """A small result table as Markdown; `most` rows are shown."""
    names = rows.columns
    got = rows.limit(most).collect()
    line = lambda cells: "| " + " | ".join("" if c is None else f"{c:.6g}" if isinstance(c, float) else str(c).replace("|", "\\|") for c in cells) + " |"
    return "\n".join([line(names), line(["---"] * len(names)), *map(line, got)])
