"""Substring dedup by line or paragraph hashing."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, stored, table

#: What parts units: a line end, or a run of blank lines.
PARTS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
#: Units of fewer words are never removed: only blank ones, unless a caller asks for more.
LEAST_WORDS = 1
OWN = {"n_units": pa.int64(), "n_removed": pa.int64(), "removed": pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), "kept": pa.string()}


def units(text: str | None, unit: str):
    """(start, end, normalised words) of each unit, empty ones included; ends leave out what parts units."""
    if not text:
        return
    at = 0
    for m in PARTS[unit].finditer(text):
        yield at, m.start(), text[at : m.start()].lower().split()
        at = m.end()
    yield at, len(text), text[at:].lower().split()


def digest(words: list[str]) -> bytes:
    return hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=16).digest()


def dedup_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "line", least_words: int = LEAST_WORDS) -> DataFrame:
    """Adds n_units, n_removed, removed (character ranges [start, end) of the original text) and kept to every document.

    Units are lower-cased and their white space folded; equal units form a group over the whole table, of which the one
    with the smallest (id, place) stays. Kept text: the units that stay, joined by what stood before each of them in the
    original (none before the first). Null ids rank first; rows with the same id and text are one document given twice,
    and get the same result; a null text has no units and kept is null, an empty one is one blank unit that stays; an
    empty table gives an empty one. A long text is held whole in its task. Columns called like ours
    are replaced, all others are kept, whatever their names.

    Groups are counted and their first member found before and in the shuffle (partial aggregates), so one unit that
    fills a third of the table costs no task more than others; only groups of two and more are joined back, by a join of
    two tables, so that adaptive execution deals a hot unit's occurrences to several tasks.
    """
    given = docs.drop(*[c for c in OWN if c in docs.columns])
    names = given.columns
    apart = [f"_doc{k}" for k in range(len(names))]  # so that no name clashes with one of ours
    id_col, text_col = apart[names.index(id_col)], apart[names.index(text_col)]
    docs = lean(given).toDF(*apart)
    key = docs.withColumn("_h", F.xxhash64(text_col))

    def digests(batches):
        for b in batches:
            rows = {"id": [], "h": [], "unit": [], "digest": []}
            for i, h, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for n, (_, _, w) in enumerate(units(text, unit)):
                    if len(w) >= least_words:
                        rows["id"].append(i)
                        rows["h"].append(h)
                        rows["unit"].append(n)
                        rows["digest"].append(digest(w))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("id", b.schema.field(0).type), ("h", pa.int64()), ("unit", pa.int32()), ("digest", pa.binary())]))

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("h", T.LongType()), T.StructField("unit", T.IntegerType()), T.StructField("digest", T.BinaryType())])
    found = stored(key.select(F.col(id_col), F.col("_h"), F.col(text_col)).mapInArrow(digests, schema), "units")
    place = F.struct("id", "h", "unit")
    groups = found.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = stored(groups.select("digest", "first"), "groups")  # so the join is nothing but a join, whose hot digests are split
    later = stored(found.join(groups, "digest").filter(place != F.col("first")).select("id", "h", "unit"), "later")
    gone = later.groupBy("id", "h").agg(F.collect_set("unit").alias("_gone"))
    same = F.col(f"d.{id_col}").eqNullSafe(F.col("g.id")) & (F.col("d._h") == F.col("g.h"))
    joined = key.alias("d").join(gone.alias("g"), same, "left").select(*[F.col(f"d.`{c}`") for c in apart], "g._gone")

    base = docs.columns
    at = base.index(text_col)

    def cut(batches):
        for b in batches:
            n_units, n_removed, removed, kept = [], [], [], []
            for text, gone in zip(b.column(at).to_pylist(), b.column(len(base)).to_pylist(), strict=True):
                gone, parts, spans, last, n = set(gone or ()), [], [], 0, 0
                for n, (i, j, _) in enumerate(units(text, unit), 1):  # noqa: B007
                    if n - 1 in gone:
                        spans.append({"start": i, "end": j})
                    else:
                        parts.append((text[last:i] if parts else "") + text[i:j])
                    last = j
                n_units.append(n)
                n_removed.append(len(gone))
                removed.append(spans)
                kept.append(None if text is None else "".join(parts))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(base)], *(pa.array(v, t) for v, t in zip((n_units, n_removed, removed, kept), OWN.values(), strict=True))], names=[*base, *OWN])

    spans = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    more = [T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", spans), T.StructField("kept", T.StringType())]
    return joined.mapInArrow(cut, T.StructType([*docs.schema.fields, *more])).toDF(*names, *OWN)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """removed: the character ranges as start-end, comma-joined; text: what is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = F.array_join(F.transform("removed", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), ",")
    return dedup_units(docs).select("doc_id", "n_units", "n_removed", spans.alias("removed"), F.col("kept").alias("text"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents WHERE text <> ''),
n AS (SELECT *, regexp_extract_all(lower(line), '\S+') AS w, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS begin_at FROM l),
r AS (SELECT *, len(w) >= 1 AND row_number() OVER (PARTITION BY array_to_string(w, ' ') ORDER BY doc_id, k) > 1 AS gone FROM n),
g AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (gone) AS n_removed, string_agg(concat(begin_at::BIGINT, '-', (begin_at + length(line))::BIGINT), ',' ORDER BY k) FILTER (gone) AS removed, string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone) AS text FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n_units, 0) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN d.text IS NOT NULL THEN coalesce(g.text, '') END AS text
FROM documents d LEFT JOIN g USING (doc_id)
"""
