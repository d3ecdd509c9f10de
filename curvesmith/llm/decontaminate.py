"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import lean, table

#: Words are runs of these bytes of UTF-8 after A-Z went to a-z: digits, a-z, and all that is not ASCII.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
WINDOW = 10
#: An automaton is built over at most this much benchmark text (about 40 times as much memory); a larger benchmark goes
#: through several automata, each in its own pass over the rows.
BLOCK_BYTES = 2 << 20
NONE = hashlib.sha256(b"").hexdigest()
OWN = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items_sha256": pa.string(), "contaminated": pa.bool_()}
_built: dict = {}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(FOLD).split()


def windows(items: list[tuple[str, str | None]], width: int = WINDOW) -> dict[str, set[str]]:
    """Window (with a space at either end; a character a byte) to the ids of the items that hold it."""
    out: dict[str, set[str]] = defaultdict(set)
    for item, text in items:
        w = words_of(text)
        for i in range(max(1, len(w) - width + 1) if w else 0):
            out[" " + b" ".join(w[i : i + width]).decode("latin-1") + " "].add(item)
    return out


def automaton(key: str, items: list[tuple[str, str | None]], width: int):
    """Built once in each Python worker."""
    import ahocorasick

    if key not in _built:
        a = ahocorasick.Automaton()
        for k, ids in windows(items, width).items():
            a.add_word(k, (len(k), tuple(sorted(ids))))
        if len(a):
            a.make_automaton()
        _built.clear()
        _built[key] = a
    return _built[key]


def scan(norm: bytes, a) -> tuple[list[tuple[int, int]], set[str]]:
    """Word ranges [from, to) of the windows that occur, merged and ascending, and the ids of their items."""
    spans: list[list[int]] = []
    ids: set[str] = set()
    if not len(a):
        return [], ids
    at, word = 0, 0  # words before byte `at`
    for end, (size, own) in a.iter(norm.decode("latin-1")):
        ids.update(own)
        stop = end  # the window's last space
        word += norm.count(b" ", at, stop)
        at = stop
        n = norm.count(b" ", end - size + 1, end)  # its words
        first, last = word - n, word
        while spans and spans[-1][0] >= first:  # a longer window may end later but start earlier
            last = max(last, spans.pop()[1])
        if spans and spans[-1][1] >= first:
            spans[-1][1] = max(spans[-1][1], last)
        else:
            spans.append([first, last])
    return [(i, j) for i, j in spans], ids


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for i, j in sorted([*a, *b]):
        if out and out[-1][1] >= i:
            out[-1][1] = max(out[-1][1], j)
        else:
            out.append([i, j])
    return [(i, j) for i, j in out]


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[dict]:
    """Word ranges as character ranges [start, end) of the text as it came."""
    raw = text.encode("utf-8", "replace")
    at = [(m.start(), m.end()) for m in re.finditer(rb"[^ ]+", raw.translate(FOLD))]
    chars = lambda b: len(raw[:b].decode("utf-8"))
    return [{"start": chars(at[i][0]), "end": chars(at[j - 1][1])} for i, j in spans]


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, most: int = BLOCK_BYTES) -> list[list[tuple[str, str | None]]]:
    """The benchmark in runs of about `most` bytes, read one row at a time. A null id counts as the empty string."""
    out: list[list[tuple[str, str | None]]] = [[]]
    held = 0
    for row in benchmark.select(id_col, text_col).toLocalIterator():
        size = len((row[1] or "").encode("utf-8", "replace"))
        if out[-1] and held + size > most:
            out.append([])
            held = 0
        out[-1].append(("" if row[0] is None else str(row[0]), row[1]))
        held += size
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WINDOW, spans: bool = False, most: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, n_items, items_sha256, contaminated (and with spans: hit_spans, character ranges of the
    original text) to every document. A window is `width` consecutive words of an item, or a shorter item as a whole; a
    document's word inside any occurrence is hit. Null and empty texts have no words. Rows given twice get the same result
    each; a long text is held whole in its task. Columns of docs that are called like these are replaced. An empty
    benchmark hits nothing; an empty table gives an empty one.

    The scan needs no shuffle. What is sent to executors is one block of bounded size per automaton.
    """
    import uuid

    from pyspark.sql import functions as F

    spark, names = docs.sparkSession, docs.columns
    apart = {c: f"_doc{k}" for k, c in enumerate(names)}  # so that no name clashes with one of ours
    df = lean(docs).toDF(*apart.values())
    blocks = blocks_of(benchmark, item_col, item_text, most)
    base = df.schema
    for n, block in enumerate(blocks):
        sent = spark.sparkContext.broadcast(block)
        first, final = n == 0, n == len(blocks) - 1
        df = _pass(df, base, apart[text_col], sent, uuid.uuid4().hex, width, spans, first, final)
    own = [*OWN, *(["hit_spans"] if spans else [])]
    return df.select(*[F.col(apart[c]).alias(c) for c in names if c not in own], *own)


def _pass(df, base, text_col, sent, key, width, spans, first, final):
    from pyspark.sql import types as T

    hits = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
    schema = T.StructType(list(base.fields))
    if final:
        for c, t in (("n_words", T.LongType()), ("n_hit", T.LongType()), ("n_items", T.LongType()), ("items_sha256", T.StringType()), ("contaminated", T.BooleanType())):
            schema = schema.add(c, t)
        if spans:
            schema = schema.add("hit_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))
    else:
        schema = schema.add("_hits", hits).add("_ids", T.ArrayType(T.StringType()))
    names = base.names

    def run(batches):
        a = automaton(key, sent.value, width)
        for batch in batches:
            col = batch.column(batch.schema.get_field_index(text_col))
            old = [None] * len(col) if first else list(zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True))
            n_words, found, items, texts = [], [], [], []
            for cell, was in zip(col, old, strict=True):
                text = cell.as_py()
                w = words_of(text)
                s, ids = scan(b" " + b" ".join(w) + b" ", a) if w else ([], set())
                if was:
                    s, ids = merge(s, [(h["a"], h["b"]) for h in was[0]]), ids | set(was[1])
                n_words.append(len(w))
                found.append(s)
                items.append(sorted(ids))
                texts.append(original_spans(text, s) if spans and final and s else [])
            kept = [batch.column(i) for i in range(len(names))]
            if final:
                n_hit = [sum(j - i for i, j in s) for s in found]
                more = [
                    pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() if x else NONE for x in items], pa.string()),
                    pa.array([n > 0 for n in n_hit], pa.bool_()),
                ]
                named = [*names, *OWN]
                if spans:
                    more.append(pa.array(texts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))))
                    named.append("hit_spans")
            else:
                more = [pa.array([[{"a": i, "b": j} for i, j in s] for s in found], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))]
                named = [*names, "_hits", "_ids"]
            yield pa.RecordBatch.from_arrays([*kept, *more], names=named)

    return df.mapInArrow(run, schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", *OWN)


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
i AS (SELECT item_id, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k, w FROM b WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM i),
dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
h AS (SELECT doc_id, dw.n, k, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.win = iw.win),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM h) GROUP BY 1),
hi AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
