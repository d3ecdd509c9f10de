"""Population search over formulas: one group of a grouped map is one seed or configuration. Populations evolve on a
sample of all rows, drawn by digest; errors of what is returned are those over all rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Node, num, parse, show, size, to_numpy, var
from ..sources.shared import cut

UNARY = ("sin", "cos", "exp", "log", "sqrt", "^2", "^3")
BINARY = ("+", "*", "/")
#: Rows of the sample that populations evolve on, sent to every group: those with the least digests.
SAMPLE_ROWS = 2000
RESULT = "config_id int, formula string, mse double, size int, generation int"


def grown(rng: np.random.Generator, names: list[str], depth: int) -> Node:
    if depth == 0 or rng.random() < 0.25:
        return var(str(rng.choice(names))) if rng.random() < 0.75 else num(round(float(rng.normal(0, 2)), 2))
    if rng.random() < 0.45:
        op = str(rng.choice(UNARY))
        a = grown(rng, names, depth - 1)
        return Node("^", (a, num(float(op[1])))) if op[0] == "^" else Node(op, (a,))
    return Node(str(rng.choice(BINARY)), (grown(rng, names, depth - 1), grown(rng, names, depth - 1)))


def places(n: Node, at: tuple = ()) -> list[tuple]:
    return [at] + [p for i, a in enumerate(n.args) for p in places(a, (*at, i))]


def get(n: Node, at: tuple) -> Node:
    for i in at:
        n = n.args[i]
    return n


def put(n: Node, at: tuple, new: Node) -> Node:
    if not at:
        return new
    return Node(n.op, tuple(put(a, at[1:], new) if i == at[0] else a for i, a in enumerate(n.args)), n.value)


def mutated(rng: np.random.Generator, n: Node, names: list[str]) -> Node:
    all_ = places(n)
    at = all_[rng.integers(len(all_))]
    here, kind = get(n, at), rng.random()
    if here.op == "num" and kind < 0.6:
        return put(n, at, num(here.value * (1 + rng.normal(0, 0.2)) + rng.normal(0, 0.05)))
    if kind < 0.75:
        return put(n, at, grown(rng, names, 2))
    wrap = Node(str(rng.choice(("sin", "cos", "exp"))), (here,)) if rng.random() < 0.5 else Node("*", (here, var(str(rng.choice(names)))))
    return put(n, at, wrap)


def crossed(rng: np.random.Generator, a: Node, b: Node) -> Node:
    pa, pb = places(a), places(b)
    return put(a, pa[rng.integers(len(pa))], get(b, pb[rng.integers(len(pb))]))


def scored(n: Node, x: dict[str, np.ndarray], y: np.ndarray, most: int = 30) -> tuple[float, float, float]:
    """(error, slope, intercept) of the best affine fit of the values to y; infinite if a value is undefined."""
    if size(n) > most:
        return np.inf, 0.0, 0.0
    v = np.broadcast_to(to_numpy(n, x), y.shape).astype(float)
    if not np.isfinite(v).all() or np.abs(v).max() > 1e8:
        return np.inf, 0.0, 0.0
    d = v - v.mean()
    s = float(d @ d)
    slope = float(d @ (y - y.mean())) / s if s > 1e-12 else 0.0
    intercept = float(y.mean() - slope * v.mean())
    return float(np.mean((y - slope * v - intercept) ** 2)), slope, intercept


def evolve(x: dict[str, np.ndarray], y: np.ndarray, seed: int, generations: int = 25, population: int = 120, elites: int = 10, start: list[Node] | None = None) -> list[tuple[float, Node, int]]:
    """The best of each size, as (error, formula with its affine coefficients, generation found). Seeded: the same call
    gives the same result."""
    rng = np.random.default_rng(seed)
    names = sorted(x)
    people = list(start or []) + [grown(rng, names, int(rng.integers(1, 4))) for _ in range(population - len(start or []))]
    best: dict[int, tuple[float, Node, int]] = {}
    known: dict[Node, tuple[float, float, float]] = {}
    for g in range(generations):
        rows = []
        for n in people:
            if n not in known:
                known[n] = scored(n, x, y)
            e, a, b = known[n]
            rows.append((e + 1e-4 * size(n), n))
            if np.isfinite(e) and (size(n) not in best or e < best[size(n)][0] * (1 - 1e-9)):
                full = Node("+", (Node("*", (num(a), n)), num(b)))
                best[size(n)] = (e, full, g)
        rows.sort(key=lambda r: (r[0], show(r[1])))
        if rows[0][0] < 1e-9 + 1e-4 * 8 and known[rows[0][1]][0] < 1e-10:
            break
        keep = [n for _, n in rows[:elites]]
        pick = lambda rows=rows: rows[min(rng.integers(len(rows), size=3))][1]
        people = keep + [mutated(rng, crossed(rng, pick(), pick()) if rng.random() < 0.5 else pick(), names) for _ in range(population - elites - population // 5)]
        people += [grown(rng, names, 3) for _ in range(population // 5)]
    return [best[k] for k in sorted(best)]


def sampled(rows: DataFrame, inputs: list[str], y: str, most: int = SAMPLE_ROWS) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Inputs and target of the `most` rows with the least digests of all their columns: from anywhere in the table, and
    the same however it is partitioned. Smaller tables are taken whole."""
    got = rows.withColumn("_d", F.xxhash64(*rows.columns)).orderBy("_d", *inputs, y).limit(most).select(*inputs, y).toPandas()
    return {c: got[c].to_numpy(float) for c in inputs}, got[y].to_numpy(float)


def scored_on_all(found: DataFrame, rows: DataFrame, inputs: list[str], y: str) -> DataFrame:
    """found (formula, mse, ...), with the mse of each formula as shown over all rows, in one pass: parts of it from Arrow
    batches, summed per formula. Infinite if the formula is undefined on a row. Found is a few formulas a configuration."""
    found = cut(found)
    shown = sorted(r.formula for r in found.select("formula").distinct().collect())
    trees = [parse(t) for t in shown]

    def run(batches):
        n, bad, sse = 0, np.zeros(len(trees), bool), np.zeros(len(trees))
        for pdf in batches:
            x, t = {c: pdf[c].to_numpy(float) for c in inputs}, pdf[y].to_numpy(float)
            n += len(t)
            for i, tree in enumerate(trees):
                e = np.broadcast_to(to_numpy(tree, x), t.shape) - t
                bad[i] |= not np.isfinite(e).all()
                sse[i] += float(e @ e)
        yield pd.DataFrame({"formula": shown, "n": n, "sse": np.where(bad, np.inf, sse)})

    parts = rows.select(*inputs, y).mapInPandas(run, "formula string, n bigint, sse double")
    total = F.aggregate(F.sort_array(F.collect_list("sse")), F.lit(0.0), lambda a, b: a + b)  # sorted: the same sum every time
    errors = parts.groupBy("formula").agg(F.try_divide(total, F.sum("n")).alias("mse"))
    return found.drop("mse").join(cut(errors), "formula").select(*found.columns)


def search(rows: DataFrame, inputs: list[str], y: str, configs: DataFrame, generations: int = 25) -> DataFrame:
    """configs (config_id, seed) to the best formulas of each: one task a group. The sample is a bounded number of rows
    and travels with the function; mse is over all rows."""
    x, target = sampled(rows, inputs, y)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for c in pdf.itertuples():
            out += [(c.config_id, show(n), e, size(n), g) for e, n, g in evolve(x, target, int(c.seed), generations)]
        return pd.DataFrame(out, columns=["config_id", "formula", "mse", "size", "generation"])

    return scored_on_all(configs.repartition("config_id").groupBy("config_id").applyInPandas(run, RESULT), rows, inputs, y)


def islands(rows: DataFrame, inputs: list[str], y: str, n: int, rounds: int = 2, generations: int = 10, seed: int = 1) -> DataFrame:
    """Islands in a ring: after each round, the two best formulas of an island (over all rows, as is every mse) join the
    next one's population. State between rounds is two strings an island, by an equi-join on the island's number."""
    from .select import top_k

    spark = rows.sparkSession
    x, target = sampled(rows, inputs, y)
    state = spark.range(n).select(F.col("id").cast("int").alias("config_id"), F.array().cast("array<string>").alias("guests"))
    out = None

    def round_of(r: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            found = []
            for c in pdf.itertuples():
                start = [parse(g) for g in c.guests]
                found += [(c.config_id, show(n), e, size(n), g) for e, n, g in evolve(x, target, seed + 9973 * int(c.config_id) + r, generations, start=start)]
            return pd.DataFrame(found, columns=["config_id", "formula", "mse", "size", "generation"])

        return run

    for r in range(rounds):
        out = scored_on_all(state.groupBy("config_id").applyInPandas(round_of(r), RESULT), rows, inputs, y)
        if r < rounds - 1:
            best = top_k(out, ["config_id"], ["mse", "size", "formula"], 2).groupBy("config_id").agg(F.sort_array(F.collect_list("formula")).alias("guests"))
            moved = best.select(F.pmod(F.col("config_id") + 1, F.lit(n)).cast("int").alias("config_id"), "guests")
            state = state.select("config_id").join(moved, "config_id", "left").withColumn("guests", F.coalesce("guests", F.array().cast("array<string>")))
    return out
