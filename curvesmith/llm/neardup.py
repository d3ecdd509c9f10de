"""Near-duplicate classes: BagMinHash signatures, banding, and verified multiset overlap."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import bagminhash, kernels
from .common import cut, kept, lean, partitions_for, returned, scratch, slices, stored, table, utf8
from .components import components

WIDTH, LEAST = 5, 0.8
#: Bytes of text worked on at a time.
SLICE = 1 << 20
#: Pairs whose signatures agree in a smaller share than LEAST - SLACK are not verified: six standard deviations of the
#: share at LEAST, so a pair that belongs is lost with 1e-8.
SLACK = 6 * (LEAST * (1 - LEAST) / bagminhash.COMPONENTS) ** 0.5
#: Members of a bucket, and shingles of theirs, that are compared in one task; a larger one is dealt as pairs of blocks.
BLOCK, BLOCK_SIZE = 1024, 1 << 20
#: A shingle that no more members of a cluster have is counted pair by pair; others by blocks of so many columns.
RARE, COLUMNS = 8, 2048
#: Tasks that members of one class are dealt to when they learn its smallest id.
SALTS = 16


def bags(data: np.ndarray, at: np.ndarray, width: int):
    return kernels.shingles(*kernels.words(data, at), width)


def contents(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A digest of each text's multiset of shingles; 0 for none."""
    if not len(sh):
        return np.zeros(len(at) - 1, np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mixed(sh, 3), dtype=np.uint64)])
    n = np.diff(at)
    d = kernels.mixed((total[at[1:]] - total[at[:-1]]) ^ (n.astype(np.uint64) << np.uint64(40)), 5)
    return np.where(n > 0, d | np.uint64(1), 0).view(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(id, content, size, bands, sig) of every document; size counts its shingles, sig holds 8 bits of each component."""

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in slices(offsets, SLICE):
                at = offsets[i : j + 1] - offsets[i]
                sh, sat = bags(data[offsets[i] : offsets[j]], at, width)
                x, w, doc = kernels.runs(sh, sat)
                sig = bagminhash.signatures(x, w, doc, j - i)
                keys = bagminhash.bands(sig).view(np.int64)
                short = (sig & np.uint64(0xFF)).astype(np.uint8)
                content = contents(sh, sat)
                flat = pa.array(keys.reshape(-1), pa.int64())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * keys.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(content), pa.array(np.diff(sat)), lists, pa.array([r.tobytes() for r in short], pa.binary())], names=["id", "content", "size", "bands", "sig"])
        returned()

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("content", T.LongType()), T.StructField("size", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two sorted multisets."""
    both = np.concatenate([a, b])
    x, inv = np.unique(both, return_inverse=True)
    na, nb = np.bincount(inv[: len(a)], minlength=len(x)), np.bincount(inv[len(a) :], minlength=len(x))
    most = np.maximum(na, nb).sum()
    return float(np.minimum(na, nb).sum() / most) if most else 0.0


def verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Those (a, b) whose multisets overlap by `least` or more. texts: (content, text)."""
    left = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("ta")), "a")
    full = left.join(texts.select(F.col("content").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            (da, oa), (db, ob) = utf8(batch.column(2)), utf8(batch.column(3))
            keep = np.zeros(batch.num_rows, bool)
            for i, j in slices(oa + ob, SLICE):
                sa, ia = bags(da[oa[i] : oa[j]], oa[i : j + 1] - oa[i], width)
                sb, ib = bags(db[ob[i] : ob[j]], ob[i : j + 1] - ob[i], width)
                for k in range(j - i):
                    n, m = ia[k + 1] - ia[k], ib[k + 1] - ib[k]
                    if min(n, m) >= least * max(n, m):
                        keep[i + k] = overlap(sa[ia[k] : ia[k + 1]], sb[ib[k] : ib[k + 1]]) >= least
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return full.mapInArrow(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, least: float = LEAST) -> DataFrame:
    """(id, class_id) of every document: the smallest id among all that it is linked to, directly or through others, by
    a weighted Jaccard similarity of `least` or more between multisets of `width`-word shingles.

    1. Each text is signed; texts with equal multisets share a content digest and count once from here on.
    2. In each band's bucket all contents are paired with the smallest: as many pairs as members, not their square.
    3. Pairs are verified on the texts; components of the verified links are found.
    4. In buckets that still hold several components, members of different ones are compared by signature in blocks of
       bounded size. Those that agree form clusters, whose texts are compared in one task each; what leaves it are links
       that join components, fewer than the cluster has members, whatever the number of pairs.

    Texts of fewer words than `width` are one shingle; texts without words are classes of their own, as nothing can be
    said of them. A null id is not less than any other id: a class has a null class_id only if it has no other.
    Rows with the same id and text fall in one class; an empty table gives no rows; other columns of docs are not looked
    at. A very long text is worked on by itself, in memory of about 80 bytes for each of its own. Contents are 64-bit
    digests.
    """
    rows = stored(sign(lean(docs), id_col, text_col, width), "signed")
    with scratch(docs.sparkSession):
        named = kept(_named(docs, rows, id_col, text_col, width, least))
    found = rows.select("id", "content").join(named, "content", "left")
    return found.select("id", F.when(F.col("named"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def _named(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, width: int, least: float) -> DataFrame:
    """(content, class_id, named) for each content that is linked to another or occurs more than once."""
    known = rows.filter("content <> 0")
    members = known.select("content", "bands", "size").dropDuplicates(["content"]).select("content", "size", F.explode("bands").alias("band"))
    bucket = cut(members.groupBy("band").agg(F.min("content").alias("low"), F.max("content").alias("high")).filter("low < high").select("band", "low"))
    shared = stored(members.join(bucket, "band").select("band", "low", "content", "size"), "shared")
    stars = cut(shared.filter("content <> low").select(F.col("content").alias("a"), F.col("low").alias("b")).distinct())

    wanted = stars.select(F.col("a").alias("content")).unionByName(stars.select(F.col("b").alias("content"))).distinct()
    sigs = stored(known.select("content", "sig").join(wanted, "content").dropDuplicates(["content"]), "sigs")
    likely = cut(agreeing(stars, sigs, least - SLACK))
    links = cut(verified(likely, _texts(docs, known, _ends(likely), id_col, text_col, width), width, least))
    comp = cut(components(links))

    placed = cut(shared.join(comp.withColumnRenamed("node", "content"), "content", "left").select("band", "low", "content", "size", F.coalesce("root", "content").alias("root")))
    heavy = F.ceil(F.sum(F.col("size")) / F.lit(float(BLOCK_SIZE)))
    split = placed.groupBy("band").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(BLOCK))), heavy).cast("int").alias("parts"))
    mixed = placed.filter("content <> low").join(split.filter("r0 < r1").select("band", "parts"), "band")
    clusters = cut(across(mixed.join(sigs, "content"), least - SLACK).dropDuplicates(["cluster", "content"]))
    if not clusters.isEmpty():
        texts = _texts(docs, known, clusters.select("content").distinct(), id_col, text_col, width)
        more = joining(clusters.join(texts, "content"), width, least).distinct()
        comp = cut(components(links.unionByName(more)))

    firsts = known.groupBy("content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    named = cut(firsts.join(comp.withColumnRenamed("node", "content"), "content", "left").filter("n > 1 or root is not null").select("content", F.coalesce("root", "content").alias("root"), "first"))
    salt = F.pmod(F.xxhash64("content"), F.lit(SALTS))
    least_id = named.groupBy("root").agg(F.min("first").alias("class_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return cut(named.withColumn("salt", salt.cast("int")).join(least_id, ["root", "salt"]).select("content", "class_id", F.lit(True).alias("named")))


def agreeing(pairs: DataFrame, sigs: DataFrame, least: float) -> DataFrame:
    """Those (a, b) whose signatures agree in a share of `least` or more."""
    both = pairs.join(sigs.select(F.col("content").alias("a"), F.col("sig").alias("sa")), "a")
    both = both.join(sigs.select(F.col("content").alias("b"), F.col("sig").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches):
        for batch in batches:
            x, y = (_flat(batch.column(k)) for k in (2, 3))
            mask = pa.array((x == y).mean(1) >= least) if batch.num_rows else pa.array([], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return both.mapInArrow(run, "a bigint, b bigint")


def _flat(sigs: pa.Array) -> np.ndarray:
    """Signatures, all of one length, as rows of bytes."""
    data, at = utf8(sigs)
    return data.reshape(len(at) - 1, -1) if len(at) > 1 else np.zeros((0, 1), np.uint8)


def _groups(batches, keys: list[str]):
    """Tables of the rows with equal keys, one after another; rows come in order of the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        new[0] = first != last
        starts = np.flatnonzero(new)
        begin = 0
        for i in starts:
            if i > begin:
                held.append(batch.slice(begin, i - begin))
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held, begin = [], int(i)
        held.append(batch.slice(begin))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _united(label: np.ndarray, k: int, near: np.ndarray) -> list[int]:
    """Gives k and all of near one label; returns one of near for each label that was joined to k's."""
    other = near[label[near] != label[k]]
    if not len(other):
        return []
    names, at = np.unique(label[other], return_index=True)
    label[np.isin(label, names)] = label[k]
    return other[at].tolist()


def across(members: DataFrame, least: float) -> DataFrame:
    """members (band, content, root, parts, sig) to (cluster, content, root): clusters of members of one bucket that
    agree by signature, directly or through others, with members of other components. Buckets stream through a task one
    after another; one of more than a block comes as pairs of blocks. A cluster is named by a digest of its members, so
    those that several bands find are one. Pairs with a bucket's smallest member were seen before."""
    own = F.pmod(F.xxhash64("content"), F.col("parts")).cast("int")
    dealt = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("band", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "content", "root", "sig")
    key = ["band", "i", "j"]
    dealt = dealt.repartition(partitions_for(members.sparkSession), *key).sortWithinPartitions(*key)

    def run(batches):
        for g in _groups(batches, key):
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            own, content, root = (g.column(c).to_numpy() for c in ("own", "content", "root"))
            if (root == root[0]).all():
                continue
            sig = _flat(g.column("sig"))
            label, touched = np.arange(len(own)), np.zeros(len(own), bool)
            right = np.flatnonzero(own == j)
            for k in np.flatnonzero(own == i):
                c = right[(right > k) | (i != j)]
                c = c[root[c] != root[k]]
                c = c[(sig[c] == sig[k]).mean(1) >= least]
                if len(c):
                    touched[k] = touched[c] = True
                    _united(label, k, c)
            at = np.flatnonzero(touched)
            if not len(at):
                continue
            at = at[np.lexsort((content[at], label[at]))]
            start = np.flatnonzero(np.append(True, label[at][1:] != label[at][:-1]))
            name = np.add.reduceat(kernels.mixed(content[at].view(np.uint64), 11), start)
            name = np.repeat(kernels.mixed(name, 12), np.diff(np.append(start, len(at)))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(content[at]), pa.array(root[at])], names=["cluster", "content", "root"])

    return dealt.mapInArrow(run, "cluster bigint, content bigint, root bigint")


def shared_counts(sh: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(n, n): how many shingles, repeats counted, each two of n texts have in common. sh: their sorted shingles, at:
    where each text's begin. The k-th occurrence of a shingle in a text is an item of its own, so this is a product of
    matrices of ones: rare items are counted pair by pair, frequent ones by blocks of columns."""
    n = len(at) - 1
    out = np.zeros((n, n))
    text = np.repeat(np.arange(n), np.diff(at))
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (text[1:] != text[:-1])
    nth = np.arange(len(sh)) - np.maximum.accumulate(np.where(new, np.arange(len(sh)), 0))
    item = np.where(nth == 0, sh, kernels.mixed(sh ^ kernels.mixed(nth.astype(np.uint64), 21), 22))
    order = np.lexsort((text, item))
    item, text = item[order], text[order]
    start = np.flatnonzero(np.append(True, item[1:] != item[:-1])) if len(item) else np.zeros(0, np.int64)
    size = np.diff(np.append(start, len(item)))
    pairs = []
    for m in np.unique(size[(size > 1) & (size <= RARE)]):
        rows = text[start[size == m][:, None] + np.arange(m)]
        pairs += [rows[:, a] * n + rows[:, b] for a in range(m) for b in range(a + 1, m)]
    if pairs:
        out += np.bincount(np.concatenate(pairs), minlength=n * n).reshape(n, n)
    often = np.flatnonzero(size > RARE)
    for k in range(0, len(often), COLUMNS):
        cols = often[k : k + COLUMNS]
        ones = np.zeros((n, len(cols)), np.float32)
        where = np.repeat(start[cols], size[cols]) + np.arange(size[cols].sum()) - np.repeat(np.cumsum(size[cols]) - size[cols], size[cols])
        ones[text[where], np.repeat(np.arange(len(cols)), size[cols])] = 1
        out += np.triu(ones @ ones.T, 1)
    return out + out.T


def joining(clusters: DataFrame, width: int, least: float) -> DataFrame:
    """clusters (cluster, content, root, text) to links (a, b): pairs that overlap by `least` or more, as many as it
    takes to join all members whose pairs do; members of one root are joined from the start."""
    dealt = clusters.select("cluster", "content", "root", "text").repartition(partitions_for(clusters.sparkSession), "cluster").sortWithinPartitions("cluster")

    def run(batches):
        for g in _groups(batches, ["cluster"]):
            data, offsets = utf8(g.column("text"))
            sh, at = bags(data, offsets, width)
            size = np.diff(at)
            both = shared_counts(sh, at)
            most = size[:, None] + size[None, :] - both
            near = (both / np.maximum(most, 1) >= least) & (most > 0)
            content = g.column("content").to_numpy()
            _, label = np.unique(g.column("root").to_numpy(), return_inverse=True)
            a, b = [], []
            for k in range(len(label)):
                for c in _united(label, k, np.flatnonzero(near[k])):
                    a.append(max(content[k], content[c]))
                    b.append(min(content[k], content[c]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
            returned()

    return dealt.mapInArrow(run, "a bigint, b bigint")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("content")).unionByName(pairs.select(F.col("b").alias("content"))).distinct()


def _texts(docs: DataFrame, known: DataFrame, wanted: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(content, text) for the contents wanted; rows that share an id are told apart by their content."""
    held = known.select("id", "content").join(wanted, "content").groupBy("content").agg(F.min("id").alias("_id"))
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(held, F.col("id").eqNullSafe(F.col("_id"))).select("content", "text")

    def run(batches):
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            own = np.concatenate([contents(*bags(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)) for i, j in slices(offsets, SLICE)] or [np.zeros(0, np.int64)])
            mask = pa.array(own == batch.column(0).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["content", "text"])

    return stored(found.mapInArrow(run, "content bigint, text string").dropDuplicates(["content"]), "texts")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_classes(docs).select(F.col("id").alias("doc_id"), "class_id")


#: All pairs of texts that share a shingle, by their multisets, and the components of those that overlap enough.
OP4_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM w WHERE len(w) > 0)),
t AS (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id, s) AS k FROM s),
n AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM t a JOIN t b ON a.s = b.s AND a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE c::DOUBLE / (x.n + y.n - c) >= 0.8),
r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT q.node, r.low FROM r JOIN (SELECT a AS near, b AS node FROM e UNION ALL SELECT b, a FROM e) q ON r.doc_id = q.near)
SELECT doc_id, min(low) AS class_id FROM r GROUP BY 1
"""
