"""Shared helpers: tables, the shared checkpoint folder, and Arrow text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import threading
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own if it is unset, as in tests.
    Only a local master gets one of its own: on a cluster, executors would each write to their own disk."""
    sc = spark.sparkContext
    set_dir = sc.getConf().get("spark.checkpoint.dir")
    if set_dir:
        return set_dir
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="curvesmith-ckpt-")
    sc.setCheckpointDir(own)
    return own


def cut(df: DataFrame) -> DataFrame:
    """Computes df once, as a table in the shared folder, so that a lost executor costs no recomputation. Not checkpoint():
    that keeps what the optimizer has inferred of df, which multiplies from round to round of an iteration."""
    return stored(df, "cut")


#: Of each thread: the tables of the scratches that are open, innermost last, and the path of each stored table.
_open = threading.local()


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder; inside a scratch it is deleted at its end."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.parquet(path)
    out._stored_at = path
    if stack := getattr(_open, "stack", None):
        stack[-1].add(path)
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables that are stored inside are deleted at the end, but for kept ones. What is computed inside must be stored
    (and kept) before the end, as a DataFrame is only a plan."""
    stack = _open.stack = getattr(_open, "stack", [])
    stack.append(set())
    try:
        yield
    finally:
        for path in stack.pop():
            deleted(spark, path)


def kept(df: DataFrame) -> DataFrame:
    """A stored table of the innermost scratch that outlives it (to the end of the scratch around it, if there is one)."""
    stack = getattr(_open, "stack", [])
    if stack:
        stack[-1].discard(df._stored_at)
        if len(stack) > 1:
            stack[-2].add(df._stored_at)
    return df


def done_with(df: DataFrame) -> None:
    """Deletes a stored table that nothing reads any more, as the last round's of an iteration."""
    if stack := getattr(_open, "stack", None):
        stack[-1].discard(df._stored_at)
    deleted(df.sparkSession, df._stored_at)


def deleted(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows in an Arrow batch at most: texts are long, and batches are held on both sides of the pipe to Python.
BATCH_ROWS = 1000


def lean(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches no longer than BATCH_ROWS."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(name)) <= BATCH_ROWS:
        df.sparkSession.conf.set(name, str(BATCH_ROWS))
    return df


def returned() -> None:
    """Gives freed memory back to the system: Python workers live on from task to task, and would keep their peak."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def partitions_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column in one array and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, off, data = col.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(off, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, most: int):
    """Runs (i, j) of rows of about `most` bytes together; a longer row is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j
