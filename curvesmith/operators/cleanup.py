"""Cleaning of evolved graphs: dead nodes of a whole table of graphs, and duplicates, weak nodes and crooked weights of a
population over all rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import graph as graphs_
from .gram import Sums, _filled

#: Weights below count as none; correlation of duplicates; what eliminations and snaps may cost; eliminations.
NONE, SAME, ELIMINATE, SNAP, MOST = 1e-8, 0.9999, 1.05, 1.02, 10
#: Parts of whole numbers that weights are snapped to.
PARTS = (1, 2, 3, 4)
#: A population of more nodes is refused: it is sent to all executors.
MOST_NODES = 100_000


def without_dead(graphs: DataFrame, nodes: str = "nodes", weights: str = "weights") -> DataFrame:
    """The graphs without nodes that have no weight and that no node with a weight needs, children renumbered; adds `live`,
    the kept nodes' old places. `nodes` is an array of structs with left and right (null: none); children stand before their
    parents, so one sweep from the last node back reaches all that is needed, in plain expressions on each row, with nothing
    shuffled. Graphs that are null stay null; one without any weight loses all its nodes."""
    n = F.size(nodes)
    weighted = F.filter(F.transform(F.col(weights), lambda w, i: F.when(F.abs(w) > NONE, i)), lambda i: i.isNotNull())
    placed = F.transform(F.col(nodes), lambda x, i: F.struct(i.alias("at"), x["left"].cast("int").alias("left"), x["right"].cast("int").alias("right")))
    reach = lambda live, x: F.when(F.array_contains(live, x["at"]), F.array_union(live, F.filter(F.array(x["left"], x["right"]), lambda c: c.isNotNull()))).otherwise(live)
    out = graphs.withColumn("live", F.when(n > 0, F.array_sort(F.reduce(F.reverse(placed), weighted, reach))).otherwise(F.array().cast("array<int>")))
    new = lambda c: (F.array_position(F.col("live"), c) - 1).cast("int")
    kept = F.transform("live", lambda i: F.get(F.col(nodes), i))
    return out.withColumns({nodes: F.transform(kept, lambda x: x.withField("left", F.when(x["left"].isNotNull(), new(x["left"].cast("int")))).withField("right", F.when(x["right"].isNotNull(), new(x["right"].cast("int"))))), weights: F.transform("live", lambda i: F.get(F.col(weights), i))})


def population_sums(rows: DataFrame, inputs: list[str], y: str, population: list[dict]) -> list[Sums]:
    """For each graph the products of its nodes' values, a constant and the target over all rows: one pass for the whole
    population. Rows on which a node of a graph is no finite number don't count for that graph."""
    if sum(len(g["nodes"]) for g in population) > MOST_NODES:
        raise ValueError("the population is too large to be sent to executors")

    def run(batches):
        total: list = [0.0] * len(population)
        for batch in batches:
            cols = [batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(inputs) + 1)]
            one = np.ones(len(cols[-1]))
            for g, graph in enumerate(population):
                a = np.column_stack([*graphs_.node_arrays(graph, cols[:-1]), one, cols[-1], one])
                a = a[np.isfinite(a).all(1)]
                total[g] = total[g] + a.T @ a
        for g, m in enumerate(total):
            if isinstance(m, np.ndarray):
                i, j = np.triu_indices(len(m))
                yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(i), g), pa.int32()), "i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": m[i, j]})

    parts = rows.select(*[F.col(c).cast("double") for c in (*inputs, y)]).mapInArrow(run, "g int, i int, j int, v double")
    got = parts.groupBy("g", "i", "j").agg(F.sum("v").alias("v")).toPandas()
    return [Sums(_filled(got[got["g"] == g], len(graph["nodes"]) + 3)) for g, graph in enumerate(population)]


def _fit(s: Sums, cols: list[int]) -> tuple[np.ndarray, float]:
    g = s.columns(cols).gram()
    w = np.linalg.pinv(g.g, rcond=1e-12, hermitian=True) @ g.c / g.scale
    return w, s.mse(cols, w)


def duplicates(s: Sums, cols: list[int]) -> list[int]:
    """The columns that are no multiple (with an offset) of an earlier one; constants count as multiples of the constant."""
    n, k = max(s.n, 1), s.k
    mean = s.a[:k, k + 1] / n
    cov = s.a[:k, :k] / n - np.outer(mean, mean)
    var = np.diag(cov)
    kept: list[int] = []
    for j in cols:
        if var[j] > 1e-12 * max(s.a[j, j] / n, 1e-300) and all(abs(cov[i, j]) <= SAME * np.sqrt(var[i] * var[j]) for i in kept):
            kept.append(j)
    return kept


def cleaned(graph: dict, s: Sums) -> tuple[dict, float, float]:
    """(graph, error before, error after) from the graph's own sums alone: no pass over the rows. Nodes that repeat an earlier
    one lose their weights, the others' are fitted again; the lightest nodes go while that costs no more than a twentieth of
    the error; weights are moved to whole numbers or simple parts where that costs no more than a fiftieth; what no weight
    needs is dropped."""
    k = len(graph["nodes"])
    every = list(range(k))
    before = s.mse([*every, k], [*graph["weights"], graph["bias"]])
    floor = 1e-12 * s.a[s.k, s.k] / max(s.n, 1)
    cols = duplicates(s, [j for j in every if abs(graph["weights"][j]) > NONE])
    w, mse = _fit(s, [*cols, k])
    bound = max(mse, floor)
    for _ in range(MOST):
        movable = [c for c in range(len(cols)) if graph["nodes"][cols[c]]["type"] != "input"]
        if not movable or len(cols) < 2:
            break
        size = [abs(w[c]) * np.sqrt(s.a[cols[c], cols[c]]) for c in movable]
        out = movable[int(np.argmin(size))]
        left = cols[:out] + cols[out + 1 :]
        w2, mse2 = _fit(s, [*left, k])
        if mse2 > bound * ELIMINATE:
            break
        cols, w = left, w2
    w, mse = _fit(s, [*cols, k])
    bound = max(mse, floor) * SNAP
    for c in np.argsort(-np.abs(w), kind="stable"):
        for part in PARTS:
            trial = w.copy()
            trial[c] = np.rint(w[c] * part) / part
            if s.mse([*cols, k], trial) <= bound:
                w = trial
                break
    weights = np.zeros(k)
    weights[cols] = w[:-1]
    need = {j for j in every if abs(weights[j]) > NONE}
    for j in reversed(every):
        if j in need:
            need |= {graph["nodes"][j][c] for c in ("left", "right") if graph["nodes"][j][c] is not None}
    place = {j: i for i, j in enumerate(sorted(need))}
    nodes = [graph["nodes"][j] | {c: place[graph["nodes"][j][c]] for c in ("left", "right") if graph["nodes"][j][c] is not None} for j in place]
    return {"nodes": nodes, "weights": [float(weights[j]) for j in place], "bias": float(w[-1])}, before, s.mse([*cols, k], w)


def clean_population(rows: DataFrame, inputs: list[str], y: str, population: list[dict]) -> list[tuple[dict, float, float]]:
    return [cleaned(g, s) for g, s in zip(population, population_sums(rows, inputs, y, population), strict=True)]
