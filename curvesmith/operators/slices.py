"""Slices of data with several inputs: one input runs through its range while the others rest at their medians, and each
place takes the target of the nearest row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import ranked

#: Cells of the grid at most, whatever the rows and inputs; what the driver sees is a row a cell.
CELLS = 1 << 15
POINTS = 256
#: Pairs of a cell and a place that are broadcast at most.
BROADCAST = 200_000


def medians(rows: DataFrame, inputs: list[str]) -> dict[str, tuple[float, float, float]]:
    """Least, greatest and median value of each input, exactly, and without ordering all values."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("input"), F.col(c).cast("double").alias("v")) for c in inputs]))
    long = rows.select(each.alias("e")).select("e.*").filter(F.col("v").isNotNull() & ~F.isnan("v"))
    n = F.col("_n")
    got = ranked.at_ranks(long, ["input"], "v", {"lo": F.lit(1), "hi": n, "a": F.floor((n + 1) / 2), "b": F.floor(n / 2) + 1}).collect()
    return {r["input"]: (r["lo"], r["hi"], (r["a"] + r["b"]) / 2) for r in got}


def places(span: dict[str, tuple[float, float, float]], inputs: list[str], points: int = POINTS) -> np.ndarray:
    """All places of all slices, slice by slice: even steps from the least to the greatest value."""
    out = np.tile([span[c][2] for c in inputs], (len(inputs) * points, 1))
    for k, c in enumerate(inputs):
        lo, hi, _ = span[c]
        out[k * points : (k + 1) * points, k] = lo + np.arange(points) * ((hi - lo) / max(points - 1, 1))
    return out


def nearest(rows: DataFrame, inputs: list[str], at: np.ndarray, tie: list[str], values: list[str]) -> DataFrame:
    """(place, distance, tie..., values...): the row nearest to each place (index into `at`, a place a row), of equally near
    ones the first by `tie`. Rows whose inputs are null or no number don't count.

    Rows fall into a grid of at most CELLS cubic cells (what an input adds to a distance is its width, so cells as wide in one
    input as in another hold near rows together). One pass takes the box of the rows of each cell; a place's nearest row is
    no farther than the farthest corner of some box, so only cells whose boxes come nearer than that can hold it. The second
    pass takes the least distance of each place from those cells, a grouped minimum of numbers; the third asks only cells whose
    boxes come as near as that, keeps the rows that are as near, and of these the first. All passes are whole, none
    compares all rows with all places, and none shuffles rows: cells that are asked are few, as most are far, and broadcast.
    """
    spark, k = rows.sparkSession, len(inputs)
    c = [F.col(i).cast("double") for i in inputs]
    usable = rows.filter(" AND ".join(f"`{i}` IS NOT NULL AND NOT isnan(`{i}`) AND abs(`{i}`) < double('inf')" for i in inputs))
    span = usable.agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(c) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    schema = T.StructType([T.StructField("place", T.LongType()), T.StructField("distance", T.DoubleType()), *[rows.schema[x] for x in (*tie, *values)]])
    if span["lo0"] is None or not len(at):
        return spark.createDataFrame([], schema)
    lo = [span[f"lo{i}"] for i in range(k)]
    width, per = cubes([span[f"hi{i}"] - lo[i] for i in range(k)])
    cell = F.lit(0).cast("long")
    for i, x in enumerate(c):
        cell = cell * per[i] + F.least(F.floor((x - F.lit(lo[i])) / F.lit(width)), F.lit(per[i] - 1))
    placed = usable.withColumn("_cell", cell)
    box = placed.groupBy("_cell").agg(*[f(x).alias(f"{n}{i}") for i, x in enumerate(c) for n, f in (("lo", F.min), ("hi", F.max))]).toPandas()
    low, high = (box[[f"{n}{i}" for i in range(k)]].to_numpy() for n in ("lo", "hi"))
    ids = box["_cell"].to_numpy()

    def asked(most: dict[int, float]) -> DataFrame:
        """placed with the places that need a row's cell, and its squared distance to each: cells within the farthest corner of
        some box, or within the squared distance that is known of a place."""
        need = []
        for p, q in enumerate(at):
            near = (np.maximum(np.maximum(low - q, q - high), 0) ** 2).sum(1)
            far = most.get(p, np.inf) if most else (np.maximum(np.abs(low - q), np.abs(high - q)) ** 2).sum(1).min()
            need += [(int(ids[j]), p, float(far), *map(float, q)) for j in np.flatnonzero(near <= far * (1 + 1e-9))]
        places = spark.createDataFrame(need, "_cell long, place long, _most double, " + ", ".join(f"_q{i} double" for i in range(k)))
        both = placed.join(F.broadcast(places) if len(need) <= BROADCAST else places, "_cell")
        square = F.lit(0.0)
        for i, x in enumerate(c):
            d = x - F.col(f"_q{i}")
            square = square + d * d
        return both.withColumn("_d", square)

    least = {r["place"]: r["d"] for r in asked({}).groupBy("place").agg(F.min("_d").alias("d")).collect()}  # a row a place
    best = F.min(F.struct("_d", *tie, *values)).alias("b")
    out = asked(least).filter(F.col("_d") <= F.col("_most")).groupBy("place").agg(best)
    return out.select("place", F.sqrt("b._d").alias("distance"), *[F.col(f"b.{x}") for x in (*tie, *values)])


def cubes(spans: list[float]) -> tuple[float, list[int]]:
    """The width of cubic cells over given spans, and how many of them each span holds: CELLS of them at most in all."""
    count = lambda w: [max(1, min(CELLS, int(np.ceil(s / w)))) for s in spans]
    top = max(spans)
    if not top > 0:
        return 1.0, [1] * len(spans)
    small, large = top / CELLS / 2, top
    for _ in range(60):
        mid = (small * large) ** 0.5
        small, large = (small, mid) if np.prod(count(mid), dtype=float) <= CELLS else (mid, large)
    return large, count(large)


def slices(rows: DataFrame, inputs: list[str], y: str, tie: list[str], points: int = POINTS) -> DataFrame:
    """(input, pos, x, y, distance, tie...): a curve for each input, to take features of as of any curve."""
    span = medians(rows, inputs)
    if len(span) < len(inputs):
        return nearest(rows.limit(0), inputs, np.zeros((0, len(inputs))), tie, [y]).select(F.lit("").alias("input"), F.lit(0).alias("pos"), F.lit(0.0).alias("x"), y, "distance", *tie)
    at = places(span, inputs, points)
    found = nearest(rows, inputs, at, tie, [y])
    k, pos = F.floor(F.col("place") / points).cast("int"), (F.col("place") % points).cast("int")
    name = F.element_at(F.array(*[F.lit(c) for c in inputs]), k + 1)
    lo, step = (F.element_at(F.array(*[F.lit(float(v)) for v in vs]), k + 1) for vs in ([span[c][0] for c in inputs], [(span[c][1] - span[c][0]) / max(points - 1, 1) for c in inputs]))
    return found.select(name.alias("input"), pos.alias("pos"), (lo + pos * step).alias("x"), y, "distance", *tie)


def greatest(predictions: DataFrame, keys: list[str], operator: str, probability: str) -> DataFrame:
    """An operator counts as likely as in the slice where it is likeliest."""
    return predictions.groupBy(*keys, operator).agg(F.max(probability).alias(probability))

