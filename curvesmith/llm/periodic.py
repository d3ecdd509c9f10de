"""Runs of repeated words: suffix array, longest previous factors, LZ blocks, extensions at block boundaries, copies."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, returned, table

#: A run is at least this many words long, and this many times its period.
LEAST, TIMES = 6, 4
#: Words whose suffixes are sorted together; a longer text is sorted by itself.
TOGETHER = 1 << 18


def suffix_array(code: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes of code in order, and for each k the ranks of all positions by their first 2^k symbols (equal rank: equal
    symbols; what reaches over the end ranks before all else), up to where all differ. Only suffixes that are still tied are
    sorted again."""
    n = len(code)
    rank = np.append(np.unique(code, return_inverse=True)[1].astype(np.int64) + 1, 0)
    order = np.argsort(rank[:-1], kind="stable")
    ranks, width = [rank], 1
    while True:
        r = rank[order]
        new = np.ones(n + 1, bool)
        new[1:n] = r[1:] != r[:-1]
        group = np.flatnonzero(new)
        size = np.diff(group)
        tied = np.repeat(size > 1, size)
        at = np.flatnonzero(tied)
        if not len(at):
            return order, ranks
        who = order[at]
        # a rank is the place of its group's first suffix, plus one: it stays while others are refined
        head = np.repeat(group[:-1], size)[at] + 1
        key = head * np.int64(n + 2) + rank[np.minimum(who + width, n)]
        by = np.argsort(key, kind="stable")
        order[at] = who[by]
        key = key[by]
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        place = np.empty(n + 1, np.int64)
        place[order] = np.repeat(group[:-1], size) + 1
        place[n] = 0
        start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
        place[order[at]] = at[start] + 1
        rank = place
        ranks.append(rank)
        width *= 2


def extension(ranks: list[np.ndarray], i: np.ndarray, j: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols are shared from positions i and j on (back: that end before them), for many pairs of different
    positions. Each pair looks only at the widths up to the largest that it shares from its own position on."""
    n, out = len(ranks[0]) - 1, np.zeros(len(i), np.int64)
    top, alive = np.full(len(i), -1, np.int8), np.arange(len(i))

    def same(k: int, who: np.ndarray) -> np.ndarray:
        a, b = (i[who] - out[who] - (1 << k), j[who] - out[who] - (1 << k)) if back else (i[who] + out[who], j[who] + out[who])
        inside = (np.minimum(a, b) >= 0) & (np.maximum(a, b) <= n)
        return inside & (ranks[k][np.where(inside, a, 0)] == ranks[k][np.where(inside, b, 0)])

    for k in range(len(ranks)):
        alive = alive[same(k, alive)]
        if not len(alive):
            break
        top[alive] = k
    for k in range(int(top.max(initial=-1)), -1, -1):
        who = np.flatnonzero(top >= k)
        out[who[same(k, who)]] += 1 << k
    return out


def previous_smaller(order: np.ndarray, lcp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place p of the suffix array, the nearest place before it whose suffix starts further left, as a start (-1:
    none that shares a symbol), and what both share. lcp[p] is shared by places p - 1 and p; lcp[0] is 0. Blocks of 2^k
    places are kept as their least start and least lcp; a search leaps over blocks whose starts are all larger."""
    n = len(order)
    alone = np.append(np.flatnonzero(lcp == 0), n)
    widest = int(np.diff(alone).max(initial=1))  # no search leaves the places that share a symbol
    least, shared = [order], [lcp]
    while (1 << len(least)) <= widest:
        h = 1 << (len(least) - 1)
        least.append(np.minimum(least[-1], np.concatenate([np.full(h, -1), least[-1][:-h]])))
        shared.append(np.minimum(shared[-1], np.concatenate([np.zeros(h, np.int64), shared[-1][:-h]])))
    who = np.flatnonzero(lcp > 0)
    own, at, m = order[who], who - 1, lcp[who]
    for k in range(len(least) - 1, -1, -1):  # leap over the 2^k places that end at `at`, if none of them starts further left
        leap = (least[k][at] > own) & (shared[k][at] > 0)
        m = np.where(leap, np.minimum(m, shared[k][at]), m)
        at = np.where(leap, at - (1 << k), at)
    found = order[at] < own
    start, size = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    start[who[found]] = order[at[found]]
    size[who[found]] = m[found]
    return start, size


def previous_factors(order: np.ndarray, ranks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """LPF: the longest factor at each position that also starts further left, and where it does (-1: nowhere)."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    lcp[1:] = extension(ranks, order[:-1], order[1:])
    a, la = previous_smaller(order, lcp)
    b, lb = previous_smaller(order[::-1], np.append(0, lcp[:0:-1]))
    b, lb = b[::-1], lb[::-1]
    size, start = np.empty(n, np.int64), np.empty(n, np.int64)
    size[order] = np.maximum(la, lb)
    start[order] = np.where(la >= lb, a, b)
    return size, start


def at_boundaries(ranks: list[np.ndarray], blocks: np.ndarray, n: int) -> np.ndarray:
    """Runs (start, end, period) that touch a block boundary. A block that starts in a run after its first period holds the
    rest of it; so if a run touches a boundary, it touches one where its period is at most a third of the two blocks beside
    it. A run has two periods on one side. Periods are tried at each boundary by comparing one word there, and what is left
    is extended to both sides."""
    edges = np.append(blocks, n)
    size = np.diff(edges)
    most = (size + np.append(size[1:], 0)) // (TIMES - 1)
    b = np.repeat(edges[1:], most)
    p = np.arange(len(b)) - np.repeat(np.cumsum(most) - most, most) + 1
    word, found = ranks[0], []
    ok = np.flatnonzero(b + 2 * p <= n)
    ok = ok[word[b[ok]] == word[b[ok] + p[ok]]]
    x, q = b[ok], p[ok]
    right = extension(ranks, x, x + q)
    x, q, right = x[right >= q], q[right >= q], right[right >= q]
    found.append(np.stack([x - extension(ranks, x, x + q, back=True), x + q + right, q], 1))
    ok = np.flatnonzero(b - 2 * p >= 0)
    ok = ok[word[b[ok] - 1] == word[b[ok] - 1 - p[ok]]]
    x, q = b[ok], p[ok]
    left = extension(ranks, x, x - q, back=True)
    x, q, left = x[left >= q], q[left >= q], left[left >= q]
    found.append(np.stack([x - q - left, x + extension(ranks, x, x - q), q], 1))
    out = np.concatenate(found)
    return out[out[:, 1] - out[:, 0] >= np.maximum(LEAST, TIMES * out[:, 2])]


def copied(runs: dict[tuple[int, int], int], blocks: list[tuple[int, int, int]]) -> None:
    """Adds the runs inside blocks: (start, end, source), from left to right. A run strictly inside a block is a copy of one
    inside the block's source. Runs lie in buckets by start; copies of copies are met further on."""
    bucket: dict[int, list[tuple[int, int]]] = {}
    for (s, e), q in runs.items():
        bucket.setdefault(s, []).append((e, q))
    starts = sorted(bucket)
    for a, b, src in blocks:
        if b - a < LEAST + 2:
            continue
        d, top = a - src, b - (a - src)
        i = bisect.bisect_right(starts, src)
        while i < len(starts) and starts[i] < top - 1:
            s = starts[i]
            for e, q in list(bucket[s]):
                if e < top and (s + d, e + d) not in runs:
                    runs[s + d, e + d] = q
                    if s + d not in bucket:
                        bucket[s + d] = []
                        bisect.insort(starts, s + d)
                    bucket[s + d].append((e + d, q))
            i += 1


def runs_of(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """All runs (start, length, period) of each text (arrays of word numbers from 0), by start and period. The texts are
    sorted together: no word of one is a word of another."""
    sizes = np.array([len(x) for x in texts], np.int64)
    base = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    if not n:
        return [[] for _ in texts]
    tops = np.array([int(x.max()) + 1 if len(x) else 0 for x in texts], np.int64)
    code = np.concatenate([x.astype(np.int64) for x in texts]) + np.repeat(np.cumsum(tops) - tops, sizes)
    order, ranks = suffix_array(code)
    size, source = previous_factors(order, ranks)
    step, at, i = np.maximum(size, 1).tolist(), [], 0
    while i < n:
        at.append(i)
        i += step[i]
    blocks = np.array(at, np.int64)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    least: dict[tuple[int, int], int] = {}
    for s, e, q in at_boundaries(ranks, blocks, n).tolist():
        if q < least.get((s, e), n + 1):  # of the multiples of a period only the smallest counts
            least[s, e] = q
    if not least:
        return out
    ends = np.append(blocks[1:], n)
    long = np.flatnonzero((ends - blocks >= LEAST + 2) & (source[blocks] >= 0))
    copied(least, list(zip(blocks[long].tolist(), ends[long].tolist(), source[blocks[long]].tolist(), strict=True)))
    for (s, e), q in sorted(least.items(), key=lambda x: (x[0][0], x[1])):
        k = int(np.searchsorted(base, s, side="right")) - 1
        out[k].append((s - int(base[k]), e - s, q))
    return out


def numbered(words: list[bytes]) -> np.ndarray:
    """Words as numbers from 0; equal words, and only these, have equal numbers."""
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def planted(n: int, h: int) -> np.ndarray | None:
    """Which original word stands at each place of a text of n words, where a tail is made periodic; None: no change."""
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


def find_runs(docs: DataFrame, text_col: str = "text", tail: Column | None = None) -> DataFrame:
    """Adds `runs` (array of start, length, period: word number, words, words, by start and period) and `collapsed` (the
    words that no run repeats, joined by one space) to every row. Words are what stands between blanks, tabs and line
    ends. A run is a stretch of LEAST words and of TIMES its smallest period at least that can't be longer with that
    period; each keeps its first period. `tail`: a number for each row (its CRC in the query) by which a tail of some texts
    is made periodic first, as planted() says; None: texts as they are.

    A null or empty text has no runs and collapses to the empty string. Rows given twice get the same result each. Columns
    of docs called runs or collapsed, in upper or lower case, are replaced, all others are kept; an empty table gives an
    empty one. No shuffle: texts don't meet. Some TOGETHER words are sorted together, a longer text by itself, in memory of
    about 400 bytes a word.
    """

    @F.arrow_udf("runs array<struct<start: long, length: long, period: long>>, collapsed string")
    def find(text: pa.Array, tail: pa.Array) -> pa.Array:
        runs, kept, held, count = [], [], [], 0

        def solve() -> None:
            for (words, at), own in zip(held, runs_of([a for _, a in held]), strict=True):
                runs.append(own)
                keep = np.ones(len(words), bool)
                for s, size, q in own:
                    keep[s + q : s + size] = False
                kept.append((b" ".join(words) if keep.all() else b" ".join([words[i] for i in np.flatnonzero(keep)])).decode("utf-8"))
            held.clear()

        for t, h in zip(text, tail.to_pylist(), strict=True):
            words = (t.as_py() or "").encode("utf-8").split()
            at = planted(len(words), h) if h is not None else None
            if at is not None:
                words = [words[i] for i in at]
            if held and count + len(words) > TOGETHER:
                solve()
                count = 0
            held.append((words, numbered(words)))
            count += len(words)
        solve()
        flat = [r for own in runs for r in own]
        parts = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
        each = pa.StructArray.from_arrays(parts, ["start", "length", "period"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum([len(x) for x in runs])), pa.int32()), each)
        returned()
        return pa.StructArray.from_arrays([lists, pa.array(kept, pa.string())], ["runs", "collapsed"])

    names = [c for c in docs.columns if c.lower() not in ("runs", "collapsed")]
    held = "_runs" + "_" * max(len(c) for c in docs.columns)  # no column is called like this
    own = find(F.col(f"`{text_col}`"), F.lit(None).cast("long") if tail is None else tail)
    out = lean(docs).select(*[F.col(f"`{c}`") for c in names], own.alias(held))
    return out.select(*[F.col(f"`{c}`") for c in names], F.col(f"{held}.runs").alias("runs"), F.col(f"{held}.collapsed").alias("collapsed"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_runs(docs, tail=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    best = F.reduce("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(F.encode(lines, "utf-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode(F.col("collapsed"), "utf-8"), 256).alias("collapsed_sha256"),
    )


#: Equal words of a text in all pairs at most a quarter of it apart; islands of pairs of equal distance are runs.
OP13_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten([[ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(doc_id::VARCHAR, '')])),
    lambda a, x: xor(xor(a, x) // 2, 3988292384 * (xor(a, x) % 2)))) AS h FROM documents),
a AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM t),
p AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
d AS (SELECT doc_id, n, CASE WHEN p IS NULL THEN w ELSE [CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END FOR i IN range(n)] END AS w FROM p),
i AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(w) AS w FROM d),
e AS (SELECT x.doc_id, x.i, y.i - x.i AS p FROM i x JOIN i y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND (y.i - x.i) * 4 <= x.n),
k AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, min(i) AS s, count(*) + p AS size, p FROM k GROUP BY doc_id, p, island HAVING count(*) + p >= greatest(6, 4 * p)),
r AS (SELECT doc_id, s, size, min(p) AS p FROM m GROUP BY ALL),
b AS (SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'z': size, 'p': p}, (-size, s, p)) AS b, string_agg(s || ',' || size || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM r GROUP BY 1),
x AS (SELECT DISTINCT doc_id, unnest(range(s + p, s + size)) AS i FROM r),
c AS (SELECT i.doc_id, string_agg(w, ' ' ORDER BY i.i) AS kept FROM i ANTI JOIN x ON i.doc_id = x.doc_id AND i.i = x.i GROUP BY 1)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, b.b.s AS start, b.b.z AS length, b.b.p AS period, b.b.z * 1000 // b.b.p AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN c USING (doc_id)
"""
