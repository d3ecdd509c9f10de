"""Trace analytics on streams, with the same statistics as the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def generation_stats(events: DataFrame) -> DataFrame:
    """Per run and generation: best, mean and worst fitness, and the share of distinct formulas. Batch or stream (update
    mode): only mergeable aggregates."""
    p = events.select("run_id", "generation", F.explode("population").alias("p"))
    return p.groupBy("run_id", "generation").agg(
        F.min("p.fitness").alias("best"), F.avg("p.fitness").alias("mean"), F.max("p.fitness").alias("worst"),
        F.count(F.lit(1)).alias("n"), F.size(F.collect_set("p.formula")).alias("distinct_formulas"),
    )


def event_windows(events: DataFrame, minutes: int = 60, late: str = "10 minutes") -> DataFrame:
    """Per event type and window of event time: count and sum; rows later than the watermark are left out."""
    return (
        events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", f"{minutes} minutes").alias("w"), "event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), "event_type", "n", "total")
    )


STATE = "best double, since int"
OUT = "run_id string, generation int, best double, since_improvement int, stagnant boolean"


def stagnation(stats: DataFrame, least: int = 5) -> DataFrame:
    """A row for each (run, generation, best) that comes: how many generations the run's best has stood. The state is one
    pair a run; rows of a run must come in order of generation across triggers."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best, since = state.get if state.exists else (float("inf"), 0)
        for pdf in batches:
            rows = []
            for r in pdf.sort_values("generation").itertuples():
                best, since = (r.best, 0) if r.best < best - 1e-12 else (best, since + 1)
                rows.append((key[0], r.generation, best, since, since >= least))
            yield pd.DataFrame(rows, columns=["run_id", "generation", "best", "since_improvement", "stagnant"])
        state.update((best, since))

    return stats.groupBy("run_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


#: Of a group of keys, as Arrow tables: (key, best, since, rest) of each key, and the points (key, _at, value) that wait.
WAITING = "standing binary, waiting binary"
#: Groups that keys fall into.
BUCKETS = 4096


def packed(rows: pd.DataFrame) -> bytes:
    t, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as w:
        w.write_table(t)
    return sink.getvalue().to_pybytes()


def unpacked(rows: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(pa.py_buffer(bytes(rows))).read_pandas()


def ordered_stagnation(points: DataFrame, key: str, at: str, value: str, late: str = "1 day", least: int = 5, cooldown: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """(key, at, best, since, stagnant, fires) for every point of a stream: the least value of the key so far, for how many
    points it has stood, whether for `least` or more, and whether that is to be acted on: not again within the `cooldown`
    points after the last time.

    Points may come in any order within `late`: they wait in the state until the watermark is past them, and a timer
    wakes it then even if nothing new comes. Points at the same time go by value. Those that come after the
    watermark is past them are left out. Null keys, times and values don't count; keys are of a plain type. The state of a key
    is its pending points and three numbers. Keys share `buckets` states by their hash, as each state costs a call and the
    start of a few frames whenever it wakes, however few its points: a key of its own would cost that for some 70 points.
    Batch tables give the same rows by `SELECT` windows over what lies before the watermark."""
    kind, own = points.schema[key].dataType.simpleString(), [key, "_at", "value"]
    rows = points.select(key, F.col(at).cast("timestamp").alias("at"), F.col(value).cast("double").alias("value")).na.drop().withWatermark("at", late)
    rows = rows.withColumns({"_at": F.unix_micros("at"), "_bucket": F.pmod(F.xxhash64(key), F.lit(buckets))})

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        standing, waiting = state.get if state.exists else (None, None)
        passed = state.getCurrentWatermarkMs() * 1000
        parts = [unpacked(waiting)] if waiting else []
        parts += [pdf.loc[pdf["_at"] >= passed, own] for pdf in batches]
        parts = [p for p in parts if len(p)]
        if not parts:
            return
        pending = pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0]
        ready = pending["_at"] < passed
        now, pending = pending[ready], pending[~ready]
        if len(now):
            held = {k: tuple(rest) for k, *rest in zip(*map(list, (c for _, c in unpacked(standing).items())), strict=True)} if standing else {}
            now = now.iloc[np.lexsort((now["value"], now["_at"]))]
            out = []
            for k, v in zip(now[key], now["value"], strict=True):
                best, since, rest = held.get(k, (float("inf"), 0, 0))
                best, since = (v, 0) if v < best else (best, since + 1)
                fires = since >= least and rest == 0
                held[k] = best, since, cooldown if fires else max(0, rest - 1)
                out.append((best, since, since >= least, fires))
            standing = packed(pd.DataFrame([(k, *h) for k, h in held.items()], columns=[key, "best", "since", "rest"]))
            best, since, stagnant, fires = zip(*out, strict=True)
            yield pd.DataFrame({key: now[key].to_numpy(), "_at": now["_at"].to_numpy(), "best": best, "since": since, "stagnant": stagnant, "fires": fires})
        state.update((standing, packed(pending) if len(pending) else None))
        if len(pending):
            state.setTimeoutTimestamp(max(int(pending["_at"].min()) // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    schema = f"{key} {kind}, _at bigint, best double, since int, stagnant boolean, fires boolean"
    out = rows.groupBy("_bucket").applyInPandasWithState(run, schema, WAITING, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(key, F.timestamp_micros("_at").alias("at"), "best", "since", "stagnant", "fires")


def run_available(stream: DataFrame, name: str, mode: str = "update", checkpoint: str | None = None) -> DataFrame:
    """Runs a stream over what is there now into a memory table, for tests and small reports."""
    w = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True)
    q = (w.option("checkpointLocation", checkpoint) if checkpoint else w).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def run_to_table(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream of final rows over what is there now, to a table in a shared folder: nothing of it passes the driver.
    Rows that wait for the watermark, as the last ones, are not in it yet."""
    w = stream.writeStream.outputMode("append").format("parquet").trigger(availableNow=True)
    w.option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def run_updates(stream: DataFrame, folder: str, keys: list[str]) -> DataFrame:
    """Runs a stream of groups over what is there now and gives each group's last state, finished or not. Each batch's changed
    groups go to a folder of its own, which a repeated batch overwrites; of a group the row of its last batch counts."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    w = stream.writeStream.outputMode("update").foreachBatch(put).trigger(availableNow=True)
    w.option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rest = [c for c in stream.columns if c not in keys]
    last = stream.sparkSession.read.schema(schema).parquet(f"{folder}/rows").groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last"))
    return last.select(*keys, *[F.col(f"_last.{c}") for c in rest])
