"""Sets of curve features, labels and formulas in shards, read and written by Spark's tasks."""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "curve_dataset"
SCHEMA = "features array<float>, labels array<float>, formula string"
#: What describes a set: written last, so a set without it is no whole set.
ABOUT = "_dataset.json"


def placed(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path else (pyarrow.fs.LocalFileSystem(), path)


@dataclass
class Shard(InputPartition):
    path: str


@dataclass
class Written(WriterCommitMessage):
    shard: str | None
    rows: int
    width: int


class Reader(DataSourceReader):
    """A partition for each shard that the set's description names."""

    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        fs, base = placed(self.path)
        with fs.open_input_stream(f"{base}/{ABOUT}") as f:
            return [Shard(f"{base}/{s}") for s in json.loads(f.read())["shards"]]

    def read(self, partition: Shard | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # a set without shards
            return
        fs, _ = placed(self.path)
        with fs.open_input_stream(partition.path) as f, np.load(io.BytesIO(f.read()), allow_pickle=False) as z:
            lists = [pa.array(list(z[k]), pa.list_(pa.float32())) for k in ("features", "labels")]
            yield pa.RecordBatch.from_arrays([*lists, pa.array(z["formulas"].tolist(), pa.string())], names=["features", "labels", "formula"])


class Writer(DataSourceArrowWriter):
    """Each task writes one shard under a name of its own to a folder aside. The commit moves the shards of the tasks that
    count, so one that ran twice leaves no rows twice, and writes the description; an abort drops the folder."""

    def __init__(self, path: str, classes: list[str], overwrite: bool):
        self.path, self.classes, self.overwrite, self.job = path, classes, overwrite, uuid.uuid4().hex

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, base = placed(self.path)
        got = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not got:
            return Written(None, 0, 0)
        rows = pa.concat_tables(got)
        wide = [np.array(rows.column(c).to_pylist(), np.float32) for c in ("features", "labels")]
        if any(a.ndim != 2 for a in wide) or wide[1].shape[1] != len(self.classes):
            raise ValueError("features and labels must be of one width each, and a label for each class")
        held, shard = io.BytesIO(), f"part-{uuid.uuid4().hex}.npz"
        np.savez_compressed(held, features=wide[0], labels=wide[1], formulas=np.array([f or "" for f in rows.column("formula").to_pylist()], np.str_))
        fs.create_dir(f"{base}/_aside-{self.job}", recursive=True)
        with fs.open_output_stream(f"{base}/_aside-{self.job}/{shard}") as f:
            f.write(held.getvalue())
        return Written(shard, rows.num_rows, wide[0].shape[1])

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = placed(self.path)
        done = [m for m in messages if m is not None and m.shard]
        if len({m.width for m in done}) > 1:
            self.abort(messages)
            raise ValueError("features are of different widths")
        fs.create_dir(base, recursive=True)
        old = {"shards": [], "rows": 0}
        if fs.get_file_info(f"{base}/{ABOUT}").type == pyarrow.fs.FileType.File and not self.overwrite:
            with fs.open_input_stream(f"{base}/{ABOUT}") as f:
                old = json.loads(f.read())
            if old["operator_classes"] != self.classes or done and old["feature_dim"] not in (0, done[0].width):
                self.abort(messages)
                raise ValueError("the set has other classes or widths")
        for m in done:
            fs.move(f"{base}/_aside-{self.job}/{m.shard}", f"{base}/{m.shard}")
        about = {"operator_classes": self.classes, "feature_dim": done[0].width if done else old.get("feature_dim", 0), "rows": old["rows"] + sum(m.rows for m in done), "shards": old["shards"] + [m.shard for m in done]}
        with fs.open_output_stream(f"{base}/{ABOUT}") as f:
            f.write(json.dumps(about).encode())
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = placed(self.path)
        aside = f"{base}/_aside-{self.job}"
        if fs.get_file_info(aside).type == pyarrow.fs.FileType.Directory:
            fs.delete_dir(aside)


class CurveDataset(DataSource):
    """spark.read.format("curve_dataset").load(path), and df.write.format("curve_dataset").option("classes", "sin;exp"). A
    shard is an NPZ file (features and labels as 32-bit matrices, formulas as strings), the set's description is JSON beside
    them. Rows pass from task to shard and back; the driver sees names and counts. Null formulas come back empty. A path is
    one that all executors share: a mounted folder, or any address that Arrow's file systems open."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        classes = [c for c in self.options.get("classes", "").split(";") if c]
        return Writer(self.options["path"], classes, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CurveDataset)


def about(path: str) -> dict:
    fs, base = placed(path)
    with fs.open_input_stream(f"{base}/{ABOUT}") as f:
        return json.loads(f.read())
