"""Exact substring dedup over the bytes of all documents: every byte that a repeated WINDOW-byte string covers goes,
except where the string first occurs.

1. Each window of a text is led by the least hash of its GRAM-byte grams. Runs of windows with one leader make a
   segment; equal windows have equal leaders, so segments meet by leader and a leader that occurs once ends there.
2. Of equal segments all but the first are repeats. What is left are leaders with several different segments, as where a
   shared passage begins or ends in different surroundings, or where a gram is common and nothing else is shared.
3. A window holds HALF bytes before its leader, or else as many and one more after it. So the windows of a segment before
   that point lie around one stretch (its left flank and the leader), those after it around another, and where no other
   segment has the same stretch, no window of that part is repeated, and the part ends there.
4. For the parts left the bytes are fetched, and equal windows are found by merging the Burrows-Wheeler transforms of
   shards (bwtmerge). A leader with more than HOT such segments is parted by stretches, and a stretch with more than HOT
   is dealt by window, so no task holds them all.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bwtmerge import WINDOW, later_windows
from .common import kept, lean, partitions_for, returned, scratch, slices, stored, table, utf8
from .kernels import U, mixed, powers

GRAM = 24
#: Windows' grams.
GRAMS = WINDOW - GRAM + 1
#: Bytes before the leader that the windows of a segment's left part hold; those of its right part hold FLANK from the
#: leader's start on.
HALF = (WINDOW - GRAM) // 2
FLANK = WINDOW - HALF + 1
#: Segments of one leader, or of one stretch of a leader, that are compared in one task; beyond it, windows are dealt one
#: by one.
HOT = 20_000
SLICE = 1 << 19
#: Text whose segments are compared before the shuffle.
CHUNK = 8 << 20
#: Bytes of segments merged at a time.
MERGE = 1 << 19
#: off: the leader's place in the segment; left, right: digests of the stretches, where the segment has such windows.
ROW = np.dtype([("m", "<u8"), ("c", "<u8"), ("id", "<i8"), ("lo", "<i4"), ("n", "<i2"), ("off", "<i2"), ("left", "<u4"), ("right", "<u4")])


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For all texts: leader, digest of the segment, text, first window's start in the text, number of windows, the
    leader's place in the segment, digests of its left and right stretch (0 where it has no such window)."""
    empty = tuple(np.zeros(0, t) for t in (U, U, np.int64, np.int64, np.int64, np.int64, np.uint32, np.uint32))
    n = len(data)
    if n < WINDOW:
        return empty
    up, down = powers(n)
    total = np.zeros(n + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:n], dtype=U, out=total[1:])
    gram = mixed((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    low = (gram & U(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U)
    width = 1
    while width * 2 <= GRAMS:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < GRAMS:
        low = np.minimum(low[: len(low) - (GRAMS - width)], low[GRAMS - width :])
    lead = (low & U(0xFFFFFFFF)).astype(np.int64)  # of the window that starts at each byte
    size = np.diff(at)
    fits = np.maximum(size - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(size)), fits)
    start = np.arange(len(text)) - np.repeat(np.cumsum(fits) - fits, fits) + np.repeat(at[:-1], fits)
    if not len(start):
        return empty
    lead = lead[start]
    new = np.ones(len(start), bool)
    new[1:] = (lead[1:] != lead[:-1]) | (text[1:] != text[:-1])
    i = np.flatnonzero(new)
    runs = np.diff(np.append(i, len(start)))
    s = start[i]
    e = s + runs + WINDOW - 1
    digest = mixed((total[e] - total[s]) * down[s] + runs.astype(U))
    g = lead[i]
    stretches = []
    for some, begin, end in ((g - s >= HALF, g - HALF, g + GRAM), (s + runs > g - HALF + 1, g, g + FLANK)):
        h = np.zeros(len(g), np.uint32)
        h[some] = mixed((total[end[some]] - total[begin[some]]) * down[begin[some]]) >> U(32)
        stretches.append(h)
    return gram[g], digest, text[i], s - at[text[i]], runs, g - s, *stretches


def local_repeats(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order they came in, and which of them repeat one that is earlier by (id, lo). Rows at one and the same
    place (a document given twice) count once."""
    order = np.argsort(r["c"])
    c = r["c"][order]
    near = np.zeros(len(r), bool)
    near[1:] = c[1:] == c[:-1]
    near[:-1] |= near[1:]
    i = order[near]  # only these need be put in order
    x = r[i]
    within = np.lexsort((x["lo"], x["id"], x["c"], x["m"]))
    i, x = i[within], x[within]
    again = (x["m"][1:] == x["m"][:-1]) & (x["c"][1:] == x["c"][:-1])
    same, twice = np.zeros(len(r), bool), np.zeros(len(r), bool)
    same[i[1:]] = again
    twice[i[1:]] = again & (x["id"][1:] == x["id"][:-1]) & (x["lo"][1:] == x["lo"][:-1])
    return r[~twice], same[~twice]


def scan(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (id, text) to rows (bucket, body): packed segments; those that repeat one of the same chunk have n < 0 and
    are dealt by document, so an often repeated segment doesn't crowd its leader's bucket."""

    def pack(parts):
        r, same = local_repeats(np.concatenate(parts))
        r["n"][same] *= -1
        for f in ("off", "left", "right"):  # only the first of equal segments may be compared
            r[f][same] = 0
        where = np.where(same, mixed(r["id"].view(U)), r["m"]) % U(buckets)
        order = np.argsort(where.astype(np.min_scalar_type(buckets)), kind="stable")
        r, where = r[order], where[order]
        z = zstandard.ZstdCompressor(level=1)
        ends = np.flatnonzero(np.append(where[1:] != where[:-1], True)) + 1
        begin = np.concatenate([[0], ends[:-1]])
        bodies = [z.compress(b"".join(r[f][i:j].tobytes() for f in ROW.names)) for i, j in zip(begin, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(where[begin].astype(np.int32)), pa.array(bodies, pa.binary())], names=["bucket", "body"])

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                m, c, doc, lo, n, off, left, right = segments(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                r = np.empty(len(m), ROW)
                r["m"], r["c"], r["id"], r["lo"], r["n"], r["off"], r["left"], r["right"] = m, c, ids[i:j][doc], lo, n, off, left, right
                parts.append(r)
                held += int(offsets[j] - offsets[i])
                if held >= CHUNK:
                    if sum(map(len, parts)):
                        yield pack(parts)
                    parts, held = [], 0
                    returned()
        if sum(map(len, parts)):
            yield pack(parts)
        returned()

    return docs.mapInArrow(run, "bucket int, body binary")


def unpack(body: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n = len(raw) // ROW.itemsize
    out, at = np.empty(n, ROW), 0
    for f in ROW.names:
        size = n * ROW[f].itemsize
        out[f] = np.frombuffer(raw, ROW[f], n, at)
        at += size
    return out


REPEAT, COMPARE, DEAL = 0, 1, 2


def counts(key: np.ndarray) -> np.ndarray:
    """How often each one's value occurs."""
    order = np.argsort(key)
    k = key[order]
    i = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    n = np.diff(np.append(i, len(k)))
    out = np.empty(len(k), np.int64)
    out[order] = np.repeat(n, n)
    return out


def parts_to_compare(r: np.ndarray, hot: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, m, id, lo, n) of the parts of different segments (ROW) whose windows may be repeated: those with a stretch
    that another segment of the same leader has. Parts of one segment stay together, but where a leader has too many."""
    r = r[counts(r["m"]) > 1]
    before = np.clip(r["off"].astype(np.int64) - HALF + 1, 0, r["n"])  # windows of the left part
    parts = []
    for side, n in (("left", before), ("right", r["n"] - before)):
        key = mixed(r["m"] ^ mixed(r[side].astype(U), seed=1 + (side == "right")))
        has = n > 0
        size = np.zeros(len(r), np.int64)
        size[has] = counts(key[has])
        parts.append((key, size, n))
    (_, left, _), (_, right, _) = parts
    some = (left > 1) | (right > 1)
    many = np.zeros(len(r), bool)
    many[some] = counts(r["m"][some]) > hot
    one = some & ~many
    lo, n = r["lo"].astype(np.int64), r["n"].astype(np.int64)
    whole = (lo + np.where(left > 1, 0, before), np.where(left > 1, before, 0) + np.where(right > 1, n - before, 0))
    out = [(COMPARE, r["m"][one], r["id"][one], whole[0][one], whole[1][one])]
    for (key, size, own), skip in zip(parts, (0, before), strict=True):
        for kind, rows in ((COMPARE, many & (size > 1) & (size <= hot)), (DEAL, many & (size > hot))):
            out.append((kind, key[rows], r["id"][rows], (lo + skip)[rows], own[rows]))
    return out


def meet(packed: DataFrame, buckets: int, hot: int) -> DataFrame:
    """(kind, m, id, lo, n): repeats found, and parts of segments to compare or to deal by window, with the number that
    they meet by."""

    def run(batches):
        parts = [unpack(b.as_py()) for batch in batches for b in batch.column(1)]
        if not parts:
            return
        r = np.concatenate(parts)
        done = r[r["n"] < 0]
        done["n"] *= -1
        r, same = local_repeats(r[r["n"] > 0])
        repeats = [(REPEAT, x["m"], x["id"], x["lo"], x["n"]) for x in (done, r[same])]
        for kind, *cols in repeats + parts_to_compare(r[~same], hot):
            for i in range(0, len(cols[0]), 1 << 16):
                m, ids, lo, n = (x[i : i + (1 << 16)] for x in cols)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(m), kind, np.int8)), pa.array(m.astype(U).view(np.int64)), pa.array(ids.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names=["kind", "m", "id", "lo", "n"])
        returned()

    return packed.repartition(buckets, "bucket").mapInArrow(run, "kind tinyint, m bigint, id bigint, lo int, n int")


def squeezed(docs: DataFrame) -> DataFrame:
    """docs (id, text) to (id, pack): compressed bytes, as they go through two shuffles."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data, at = utf8(batch.column(1))
            body = data.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(body[i:j]) for i, j in zip(at, at[1:], strict=False)], pa.binary())], names=["id", "pack"])

    return docs.mapInArrow(run, "id bigint, pack binary")


def fetch(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """(m, id, lo, n, body): the bytes of the segments in wanted (kind, m, id, lo, n). Those dealt by window become
    segments of one window each, led by the window's digest; one that repeats another of the same run of rows comes
    without body, as a repeat. Rows given twice have one id, and are no repeats of themselves."""
    lists = wanted.groupBy("id").agg(F.collect_list(F.struct("kind", "m", "lo", "n")).alias("parts"))
    joined = lists.join(squeezed(docs), "id").select("id", "parts", "pack")

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            m, ids, lo, n, body = [], [], [], [], []
            seen: dict = {}
            docs_at = batch.column(0).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            kinds, keys, los, counted = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            for i in np.argsort(docs_at, kind="stable"):
                doc = int(docs_at[i])
                raw = z.decompress(batch.column(2)[i].as_py())
                own = ends[i] + np.argsort(los[ends[i] : ends[i + 1]], kind="stable")
                for kind, key, at, count in zip(kinds[own].tolist(), keys[own].tolist(), los[own].tolist(), counted[own].tolist(), strict=True):
                    if kind == COMPARE:
                        m.append(key)
                        ids.append(doc)
                        lo.append(at)
                        n.append(count)
                        body.append(raw[at : at + count + WINDOW - 1])
                        continue
                    for at in range(at, at + count):
                        part = raw[at : at + WINDOW]
                        key = int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True)
                        if part in seen and seen[part] == (doc, at):
                            continue  # a row given twice meets itself
                        part = None if part in seen else part
                        if part is not None:
                            seen[part] = doc, at
                        m.append(key)
                        ids.append(doc)
                        lo.append(at)
                        n.append(1)
                        body.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int64()), pa.array(ids, pa.int64()), pa.array(lo, pa.int32()), pa.array(n, pa.int32()), pa.array(body, pa.binary())], names=["m", "id", "lo", "n", "body"])

    return joined.mapInArrow(run, "m bigint, id bigint, lo int, n int, body binary")


def compare(found: DataFrame) -> DataFrame:
    """(id, lo, n): runs of n windows, from lo on, that occur earlier. Rows come by leader, and are merged in batches of
    whole leaders. A row alone with its leader, as most windows that were dealt one by one, repeats none: the windows of a
    segment hold their leader at different places, so no two of them are equal."""

    def resolve(rows):
        ids, lo = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
        at = np.concatenate([[0], np.cumsum([len(r[3]) for r in rows])]).astype(np.int64)
        s, off = later_windows(np.frombuffer(b"".join(r[3] for r in rows), np.uint8), at, ids, lo)
        order = np.lexsort((off, s))
        s, off = s[order], off[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (off[1:] != off[:-1] + 1)
        i = np.flatnonzero(new)
        return pa.RecordBatch.from_arrays([pa.array(ids[s[i]]), pa.array((lo[s[i]] + off[i]).astype(np.int32)), pa.array(np.diff(np.append(i, len(s))).astype(np.int32))], names=["id", "lo", "n"])

    def run(batches):
        rows, held, own = [], 0, []  # own: the rows of the present leader
        for batch in batches:
            m = batch.column(0).to_pylist()
            cells = zip(m, batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            for r in cells:
                if own and r[0] != own[0][0]:
                    if len(own) > 1:
                        rows += own
                        held += sum(len(x[3]) for x in own)
                    own = []
                    if held >= MERGE:
                        yield resolve(rows)
                        rows, held = [], 0
                        returned()
                own.append(r)
        if len(own) > 1:
            rows += own
        if rows:
            yield resolve(rows)
        returned()

    by_leader = found.filter("body is not null").select("m", "id", "lo", "body").repartition(partitions_for(found.sparkSession), "m").sortWithinPartitions("m")
    return by_leader.mapInArrow(run, "id bigint, lo int, n int")


OWN = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The bytes outside the spans, and the spans made maximal."""
    whole: list[list[int]] = []
    for i, j in sorted(spans):
        if whole and i <= whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], j)
        else:
            whole.append([i, j])
    at, kept = 0, []
    for i, j in whole:
        kept.append(raw[at:i])
        at = j
    kept.append(raw[at:])
    return b"".join(kept), [(i, j) for i, j in whole]


def numbered(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """docs with `id`, a number in the order of documents: the id column itself if it is whole and unique. Otherwise rows
    are put in order of (id, digest of the text), null first, and numbered; rows with the same id and text share one."""
    ids = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    odd = ids.filter((F.col("n") > 1) | F.col(id_col).isNull()).limit(1).count()
    if not odd:
        return docs.withColumn("id", F.col(id_col).cast("long")), False
    h = F.xxhash64(text_col)
    rank = docs.select(F.col(id_col).alias("_i"), h.alias("_h")).distinct().orderBy(F.col("_i").asc_nulls_first(), "_h")
    rank = stored(rank.withColumn("id", F.monotonically_increasing_id()), "ranks")
    out = docs.withColumn("_own", h).join(rank, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_own") == F.col("_h")))
    return out.drop("_own", "_i", "_h"), True


def removed_spans(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """docs (id, text) to (id, spans): array of (lo, n), runs of windows to remove, in any order."""
    spark = docs.sparkSession
    buckets = partitions_for(spark)
    with scratch(spark):
        met = stored(meet(scan(docs, buckets), buckets, hot), "segments")
        found = stored(fetch(met.filter(F.col("kind") != REPEAT), docs), "bodies")
        spans = met.filter(F.col("kind") == REPEAT).select("id", "lo", "n")
        spans = spans.unionByName(found.filter("body is null").select("id", "lo", "n")).unionByName(compare(found))
        return kept(stored(spans.groupBy("id").agg(F.collect_list(F.struct("lo", "n")).alias("spans")), "spans"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, bodies: bool = True) -> DataFrame:
    """Every document with its n_bytes, n_removed, n_spans, kept_sha256, and unless bodies is false kept (binary) and
    removed (byte ranges).

    A null text is empty, texts shorter than a window stay whole; an empty table gives an empty one; see numbered() for
    null and repeated ids. A text is cut into windows about half a megabyte at a time, a longer one by itself, in memory
    of some 80 bytes for each of its own. Columns of docs that are called like ours are replaced. Kept bytes need not be
    valid UTF-8, as bytes are what is compared.
    """
    names = docs.columns
    apart = {c: f"_doc{k}" for k, c in enumerate(names)}  # so that no name clashes with one of ours
    rows, _ = numbered(lean(docs.toDF(*apart.values())), apart[id_col], apart[text_col])
    spans = removed_spans(rows.select("id", F.col(apart[text_col]).alias("text")), hot)
    out = _finish(rows, spans, [c for c in apart.values() if c != apart[text_col]], apart[text_col], bodies)
    own = [*OWN, "kept", "removed"] if bodies else OWN
    return out.select(*[F.col(apart[c]).alias(c) for c in names if c not in own and c != text_col], *own)


def _finish(rows: DataFrame, spans: DataFrame, others: list[str], text_col: str, bodies: bool) -> DataFrame:
    from pyspark.sql import types as T

    fields = [rows.schema[c] for c in others]
    packed = T.StructType([*fields, T.StructField("id", T.LongType()), T.StructField("pack", T.BinaryType())])

    def squeeze(batches):
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            body = [None if t is None else z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(len(others) + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(others) + 1], pa.array(body, pa.binary())], names=[*others, "id", "pack"])

    joined = rows.select(*others, "id", text_col).mapInArrow(squeeze, packed).join(spans, "id", "left").select(*others, "pack", "spans")
    k = len(others)
    out = T.StructType([*fields, *(T.StructField(c, T.LongType()) for c in OWN[:3]), T.StructField("kept_sha256", T.StringType())])
    if bodies:
        out.add("kept", T.BinaryType()).add("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    pair = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        z = zstandard.ZstdDecompressor()
        for b in batches:
            n, gone, count, sha, kept, removed = [], [], [], [], [], []
            lists = b.column(k + 1).fill_null([])
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            los, windows = (x.to_numpy(zero_copy_only=False) for x in lists.flatten().flatten())
            stops = los + windows + WINDOW - 1
            for pack, i, j in zip(b.column(k), ends, ends[1:], strict=False):
                raw = b"" if not pack.is_valid else z.decompress(pack.as_py())
                left, whole = cut_spans(raw, list(zip(los[i:j].tolist(), stops[i:j].tolist(), strict=True)))
                n.append(len(raw))
                gone.append(len(raw) - len(left))
                count.append(len(whole))
                sha.append(hashlib.sha256(left).hexdigest())
                if bodies:
                    kept.append(left if pack.is_valid else None)
                    removed.append([{"start": i, "end": j} for i, j in whole])
            arrays = [pa.array(v, pa.int64()) for v in (n, gone, count)] + [pa.array(sha, pa.string())]
            if bodies:
                arrays += [pa.array(kept, pa.binary()), pa.array(removed, pa.list_(pair))]
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *arrays], names=out.names)

    return joined.mapInArrow(run, out)


def decoded(cut: DataFrame, body: str = "kept", name: str = "kept_text") -> DataFrame:
    """Adds the bytes of a column as text, without the parts of characters that a cut left."""
    from pyspark.sql import types as T

    at = cut.columns.index(body)

    def run(batches):
        for b in batches:
            text = [None if x is None else x.decode("utf-8", "ignore") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*b.schema.names, name])

    return cut.mapInArrow(run, T.StructType([*cut.schema.fields, T.StructField(name, T.StringType())]))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs, bodies=False).select("doc_id", *OWN)


#: All windows of all texts in order; a window that is not the first of its bytes covers them.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS w FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY w ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r)),
s AS (SELECT doc_id, g, min(p) AS lo, max(p) + 100 AS hi FROM i GROUP BY 1, 2),
b AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS before FROM s),
a AS (SELECT doc_id, sum(hi - lo)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept FROM b JOIN d USING (doc_id) GROUP BY 1)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
