"""Exact top-k inner products by no-random-access aggregation over sorted lists.

Candidates are dealt to blocks, each with one sorted list a dimension. A query first meets one block; its k-th best score
there is a threshold that it carries to all others, where reading stops as soon as no unmet candidate can reach it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

#: Candidates and queries of a block: what one task holds.
CANDIDATES, QUERIES = 2048, 1024
#: Blocks of candidates at least, so that small tables also spread.
LEAST_BLOCKS = 64
#: Share of the lists that is read before the bounds are first looked at; each look doubles it.
FIRST = 0.125
#: List entries read at a time.
ENTRIES = 1 << 17


class Lists:
    """One list for each dimension: candidates in ascending order of their component."""

    def __init__(self, x: np.ndarray):
        self.x = x
        order = np.argsort(x, axis=0, kind="stable").T
        value = np.take_along_axis(x.T, order, axis=1).astype(np.float64)
        #: [0]: from the least component on; [1]: from the greatest on
        self.order = np.ascontiguousarray(np.stack([order, order[:, ::-1]]), np.int64)
        self.value = np.ascontiguousarray(np.stack([value, value[:, ::-1]]))
        self.lists = np.arange(x.shape[1])

    def read(self, up: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries lo..hi of every list (candidates, components); from the far end where the query's weight is not
        negative, so the best contributions come first. up: (queries, dimensions), 1 or 0."""
        return self.order[:, :, lo:hi][up, self.lists], self.value[:, :, lo:hi][up, self.lists]


def top_k(lists: Lists, q: np.ndarray, own: np.ndarray, names: np.ndarray, k: int, carried: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query: the candidates with the k best scores, ties to smaller names, best first; with carried thresholds,
    only those of them that reach the query's.

    Lists are read in growing parts. A candidate's score lies between what was read of it plus the least (lower bound) or
    the last read contribution (upper bound) of the lists in which it was not yet met. Reading stops when no unmet
    candidate can reach the k-th best lower bound or the threshold; those whose upper bound does are then resolved.
    own: index of the query among the candidates, or -1.
    """
    n, dims = lists.x.shape
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    floor_ = np.full(len(q), -np.inf) if carried is None else carried
    step = max(1, ENTRIES // max(1, n * dims))
    for g in range(0, len(q), step):
        live = np.arange(g, min(g + step, len(q)))
        w = q[live].astype(np.float64)
        up = (w >= 0).astype(np.int64)
        least = np.minimum(w * lists.value[0, :, 0], w * lists.value[0, :, -1])
        low, got = np.zeros((len(live), n)), np.zeros((len(live), n))
        seen: list[np.ndarray] = []
        depth, to = 0, max(1, int(n * FIRST))
        while len(live):
            ids, v = lists.read(up, depth, to)
            flat = ids + (np.arange(len(live)) * n)[:, None, None]
            gain = v * w[:, :, None]
            size = len(live) * n
            count = lambda where, weight: np.bincount(where.reshape(-1), weight.reshape(-1), size).reshape(-1, n)  # noqa: B023, E731
            low += count(flat, gain - least[:, :, None])
            last = gain[:, :, -1]
            if depth == 0:  # all that was met is at hand
                upper = count(flat, gain - last[:, :, None]) + last.sum(1)[:, None]
                got = None
            else:
                if got is None:
                    got = low - count(flat, gain - least[:, :, None]) + count(seen[0], np.broadcast_to(least[:, :, None], seen[0].shape))
                got += count(flat, gain)
                upper = got + last.sum(1)[:, None]
                for part in [*seen, flat]:
                    upper -= count(part, np.broadcast_to(last[:, :, None], part.shape))
            seen.append(flat)
            lower = low + least.sum(1)[:, None]
            mine = own[live]
            rows = np.flatnonzero(mine >= 0)
            lower[rows, mine[rows]] = -np.inf
            upper[rows, mine[rows]] = -np.inf
            kth = np.partition(lower, n - k, axis=1)[:, n - k] if n > k else np.full(len(live), -np.inf)
            kth = np.maximum(kth, floor_[live])
            done = (last.sum(1) < kth) | (to >= n)
            for r in np.flatnonzero(done):
                c = np.flatnonzero((upper[r] >= kth[r]) & (np.arange(n) != mine[r]))
                score = lists.x[c] @ q[live[r]]
                c, score = c[score >= kth[r]], score[score >= kth[r]]
                out[live[r]] = c[np.lexsort((names[c], -score))[:k]]
            stay = ~done
            if stay.any():
                shift = (np.cumsum(stay) - 1 - np.arange(len(live)))[stay] * n
                seen = [p[stay] + shift[:, None, None] for p in seen]
                live, w, up, least, low = live[stay], w[stay], up[stay], least[stay], low[stay]
                got = got[stay] if got is not None else None
            else:
                live = live[:0]
            depth, to = to, min(n, 2 * to + 8)
    return out


def packed(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(uid, id, dims, body): components floor(scale * x) as 64-bit integers. Vectors that are null or hold null or
    non-finite components are left out."""
    x = F.col(vec_col)
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.filter(good).select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("id"), F.transform(x, lambda v: v.cast("double")).alias("x"))

    def run(batches):
        for b in batches:
            values = b.column(2)
            at = values.offsets.to_numpy()
            whole = np.floor(values.values.to_numpy(zero_copy_only=False)[: at[-1]] * scale)
            if len(whole) and np.abs(whole).max() >= 2.0**63:
                raise ValueError("a component times the scale is beyond 64 bits")
            flat = whole.astype(np.int64)
            body = [flat[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(at).astype(np.int32)), pa.array(body, pa.binary())], names=["uid", "id", "dims", "body"])

    return stored(rows.mapInArrow(run, "uid bigint, id bigint, dims int, body binary"), "vectors")


def exhaustive(x: np.ndarray, q: np.ndarray, own: np.ndarray, k: int) -> list[np.ndarray]:
    """top_k() where scores have no exact place in a double, or there are no lists: by whole numbers of any size."""
    wide = x.astype(object)
    out = []
    for r, v in enumerate(q):
        score = (wide * v.astype(object)).sum(1) if x.shape[1] else np.zeros(len(x), object)
        order = sorted((i for i in range(len(x)) if i != own[r]), key=lambda i: (-score[i], i))  # noqa: B023
        out.append(np.array(order[:k], np.int64))
    return out


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_uid, query_id, rank, vec_id, score): for each row that is_query(id) holds for, the k best scores among all
    other rows, ties to the smaller id (then to the earlier row).

    Queries meet all candidates block by block: first one block each, whose k-th score they carry to the others. Each
    block keeps at most k rows a query, and those are ranked again. Blocks are dealt by row number, so no value fills one.
    A query shares its scores only with vectors of as many dimensions; those without any have score 0. An empty table, or
    one without queries, gives no rows; rows given twice are two candidates; other columns are not looked at. Components
    times the scale, and scores, must fit in 64 bits, else it is an error.
    """
    rows = packed(vectors, id_col, vec_col, scale)
    asked = rows.filter(is_query(F.col("id")))
    n, n_q = rows.count(), asked.count()
    cb, qb = max(LEAST_BLOCKS, -(-n // CANDIDATES)), max(1, -(-n_q // QUERIES))
    block = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.sequence(F.lit(0), F.lit(m - 1))
    left = rows.withColumn("cb", block("uid", cb)).withColumn("qb", F.explode(every(qb)))
    asked = asked.withColumn("qb", block("uid", qb)).withColumn("home", F.pmod(F.col("qb"), F.lit(cb)))
    first = asked.withColumn("cb", F.col("home")).withColumn("least", F.lit(None).cast("long"))
    at_home = stored(_meet(left.filter(F.pmod(F.col("qb"), F.lit(cb)) == F.col("cb")), first, k), "first")
    least = at_home.groupBy("query_uid").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    carried = asked.join(least.select(F.col("query_uid").alias("uid"), "least"), "uid", "left")
    others = carried.withColumn("cb", F.explode(F.filter(every(cb), lambda b: b != F.col("home"))))
    met = at_home.unionByName(_meet(left, others, k))
    order = Window.partitionBy("query_uid").orderBy(F.desc("score"), F.asc_nulls_first("vec_id"), F.asc("uid"))
    ranked = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_uid", "query_id", "rank", "vec_id", "score")


def _meet(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_uid, query_id, uid, vec_id, score): of each pair of blocks (qb, cb), the best k candidates of each query that
    reach its `least`."""

    def run(_, cand: pa.Table, ask: pa.Table) -> pa.Table:
        out = {c: [] for c in ("query_uid", "query_id", "uid", "vec_id", "score")}
        for d in sorted(set(ask.column("dims").to_pylist())):
            c = cand.filter(pa.compute.equal(cand.column("dims"), d))
            a = ask.filter(pa.compute.equal(ask.column("dims"), d))
            if not c.num_rows:
                continue
            x = np.frombuffer(b"".join(c.column("body").to_pylist()), np.int64).reshape(c.num_rows, d)
            q = np.frombuffer(b"".join(a.column("body").to_pylist()), np.int64).reshape(a.num_rows, d)
            uid, known = c.column("uid").to_numpy(), c.column("id").is_valid().to_numpy(zero_copy_only=False)
            ids = c.column("id").fill_null(np.iinfo(np.int64).min).to_numpy()
            order = np.lexsort((uid, ids))
            x, uid, ids, known = x[order], uid[order], ids[order], known[order]
            at = {u: i for i, u in enumerate(uid)}
            own = np.array([at.get(u, -1) for u in a.column("uid").to_pylist()])
            wide = not d or d * float(np.abs(x).max()) * float(np.abs(q).max()) >= 2.0**52
            least = np.array([-np.inf if v is None else float(v) for v in a.column("least").to_pylist()])
            best = exhaustive(x, q, own, k) if wide else top_k(Lists(x), q, own, np.arange(len(x)), k, least)
            for r, (u, i) in enumerate(zip(a.column("uid").to_pylist(), a.column("id").to_pylist(), strict=True)):
                b = best[r]
                out["query_uid"] += [u] * len(b)
                out["query_id"] += [i] * len(b)
                out["uid"] += uid[b].tolist()
                out["vec_id"] += [int(i) if ok else None for i, ok in zip(ids[b], known[b], strict=True)]
                out["score"] += [int(v) for v in (x[b].astype(object) @ q[r].astype(object) if wide and d else x[b] @ q[r])]
        return pa.table({c: pa.array(v, pa.int64()) for c, v in out.items()})

    queries = queries.select(*[F.col(c).alias(c) for c in queries.columns])  # columns of their own: both come from one table
    return candidates.groupBy("qb", "cb").cogroup(queries.groupBy("qb", "cb")).applyInArrow(run, "query_uid bigint, query_id bigint, uid bigint, vec_id bigint, score bigint")


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null vec_id is no query, and ranks first among ties as a candidate."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, lambda i: i % 50 == 0).select("query_id", "rank", "vec_id", "score")


OP9_SQL = """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.uid AS quid, q.vec_id AS query_id, c.vec_id, c.uid, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.uid <> c.uid AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id, uid)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
