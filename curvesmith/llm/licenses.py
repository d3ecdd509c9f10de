"""Licence scan: ordered signature rules behind keyword filters, on DataFrame functions only."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .license_rules import BASE, rules

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Set around a match; no normalised text holds them.
OPEN, CLOSE = "\x01", "\x02"
DETECTION = "struct<start:int,stop:int,level:int,label:string,score:double>"
OWN = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
#: A match of any rule holds one of these, so other texts see no regular expression at all.
NEEDS = (" licen", " unlicen", " spdx", " released ", " distributed ", " published ", " available ", " provided ", " covered ", " governed ", " permission ", " redistribution ", " this software ", " public domain", " all rights ", " proprietary ", " creative commons", " creativecommons ", " cc0", " mit no", " neither the name", " altered source ", " openssl ", " the names apache ")


def words(text: Column) -> Column:
    """The words of a text with a space around each; "" if there are none. lower() also changes letters beyond ASCII,
    but into letters beyond ASCII or ones that no phrase has, so words and matches stay."""
    bare = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(bare == "", "").otherwise(F.concat(F.lit(" "), bare, F.lit(" ")))


def places(norm: Column, regex: Column) -> Column:
    """Array of (start, stop): word ranges of the pattern's matches. Each match is marked in the text, so the place of
    the marked word is its index; linear in the text and its matches."""
    marked = F.regexp_replace(norm, regex, F.lit(f"{OPEN}$0{CLOSE}"))
    tokens = F.split(F.substring(marked, 2, 2**31 - 1), " ")
    at = F.filter(F.transform(tokens, lambda w, i: F.when(w.startswith(OPEN), i)), lambda i: i.isNotNull())
    to = F.filter(F.transform(tokens, lambda w, i: F.when(w.endswith(CLOSE), i + 1)), lambda i: i.isNotNull())
    return F.arrays_zip(at.alias("start"), to.alias("stop"))


def detections(norm: Column) -> Column:
    """All matches of all rules whose keyword the text holds."""
    table_ = F.from_json(F.lit(json.dumps(rules())), "array<struct<keyword:string,regex:string,label:string,level:int,score:double>>")
    near = F.filter(table_, lambda r: F.contains(norm, r["keyword"]))
    hit = F.filter(near, lambda r: F.regexp_like(norm, r["regex"]))
    return F.flatten(F.transform(hit, lambda r: F.transform(places(norm, r["regex"]), lambda p: F.struct(
        p["start"].alias("start"), p["stop"].alias("stop"), r["level"].alias("level"), r["label"].alias("label"), r["score"].alias("score")))))


def resolve(found: Column) -> Column:
    """Labels and best score of the detections that no other of the same or greater strength contains. One sweep in
    order of start, longer first, stronger first: what contains a detection comes before it, so the furthest end for
    each strength is all that has to be kept."""
    key = lambda d: F.struct(d["start"].alias("start"), (-d["stop"]).alias("back"), d["level"].alias("level"), d["label"].alias("label"), d["score"].alias("score"))
    ordered = F.array_sort(F.transform(found, key))
    zero = F.struct(*[F.lit(-1).alias(f"e{k}") for k in (1, 2, 3, 4)], F.array().cast("array<string>").alias("labels"), F.lit(0.0).alias("score"))

    def step(acc, d):
        stop = -d["back"]
        ends = [acc[f"e{k}"] for k in (1, 2, 3, 4)]
        inside = F.lit(False)
        for k, e in enumerate(ends, 1):
            inside = inside | ((d["level"] >= k) & (e >= stop))
        seen = [F.when(d["level"] == k, F.greatest(e, stop)).otherwise(e).alias(f"e{k}") for k, e in enumerate(ends, 1)]
        return F.struct(
            *seen,
            F.when(inside, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(d["label"]))).alias("labels"),
            F.when(inside, acc["score"]).otherwise(F.greatest(acc["score"], d["score"])).alias("score"),
        )

    return F.aggregate(ordered, zero, step, lambda acc: F.struct(acc["labels"].alias("labels"), acc["score"].alias("score")))


def any_of(norm: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(norm, F.lit(p))
    return out


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score to every document.

    A null or empty text has no words, no places, empty labels and score 0; rows given twice get the same result each; a long
    text is normalised whole in its task; an empty table gives an empty one. Columns of docs that are called like ours are
    replaced, all others are kept, whatever their names. There is no shuffle; only texts that hold a rule's stem see the
    rules, and only those rules whose keyword they hold are run.
    """
    names = docs.columns
    apart = [f"_doc{k}" for k in range(len(names))]  # so that no name clashes with one of ours
    rows = docs.toDF(*apart).withColumn("_norm", words(F.col(apart[names.index(text_col)])))
    norm = F.col("_norm")
    n_words = F.when(norm == "", 0).otherwise(F.length(norm) - F.length(F.replace(norm, F.lit(" "), F.lit(""))) - 1)
    based = any_of(norm, [f" {p} " for p, _ in BASE])
    starts = lambda p: F.transform(places(norm, F.lit(f"(?<= )(?:{p})(?= )")), lambda x: x["start"].cast("long"))
    base = F.when(based, F.array(*[F.struct(F.lit(label).alias("label"), starts(p).alias("starts")) for p, label in BASE]))
    gated = any_of(norm, NEEDS)
    rows = rows.withColumns({"n_words": n_words.cast("long"), "_base": base, "_found": F.when(gated, resolve(detections(norm)))})
    every = F.coalesce(F.flatten(F.transform("_base", lambda b: b["starts"])), F.array().cast("array<bigint>"))
    labels = F.coalesce(F.transform(F.filter("_base", lambda b: F.size(b["starts"]) > 0), lambda b: b["label"]), F.array().cast("array<string>"))
    found = F.coalesce(F.col("_found.labels"), F.array().cast("array<string>"))
    rows = rows.withColumns({"_every": every, "_names": labels})
    out = rows.withColumns({
        "n_base": F.size("_every").cast("long"),
        "first_word": F.array_min("_every"),
        "last_word": F.array_max("_every"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct("_names")), ","),
        "labels": F.array_join(F.array_sort(F.array_union(F.col("_names"), found)), ","),
        "score": F.greatest(F.when(F.size("_names") > 0, 0.95).otherwise(0.0), F.coalesce(F.col("_found.score"), F.lit(0.0))),
    })
    return out.select(*[F.col(a).alias(c) for a, c in zip(apart, names, strict=True) if c not in OWN], *OWN)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan_licenses(docs).select("doc_id", *OWN)


def _spaced(regex: str) -> str:
    """A pattern over words that two spaces part, for an engine without lookaround: a match takes one space on either
    side, so matches side by side are both found."""
    body = regex.removeprefix("(?<= )(?:").removesuffix(")(?= )")
    return body.replace(" ?", "\0").replace(" ", "  ").replace("\0", "(?:  )?")


def _quoted(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def _places_sql(regex: str) -> str:
    marked = f"regexp_replace(norm, ' (' || {regex} || ') ', ' ' || chr(1) || '\\1' || chr(2) || ' ', 'g')"
    return f"string_split(trim({marked}, ' '), '  ')"


_RULES = ", ".join(f"({_quoted(_spaced(x['regex']))}, {_quoted(x['label'])}, {x['level']}, {x['score']!r}::DOUBLE)" for x in rules())
_PHRASES = ", ".join(f"({_quoted(p.replace(' ', '  '))}, {_quoted(label)})" for p, label in BASE)
#: Every rule on every text, without keywords; then each detection against all others of its document.
OP1_SQL = f"""
WITH w AS (SELECT doc_id, trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' ') AS bare FROM documents),
n AS (SELECT doc_id, CASE WHEN bare = '' THEN 0 ELSE length(bare) - length(replace(bare, ' ', '')) + 1 END AS n_words, '  ' || replace(bare, ' ', '  ') || '  ' AS norm FROM w),
r(regex, label, level, score) AS (VALUES {_RULES}), b(phrase, label) AS (VALUES {_PHRASES}),
bt AS (SELECT doc_id, label, {_places_sql('phrase')} AS t FROM n, b WHERE contains(norm, '  ' || phrase || '  ')),
bp AS (SELECT doc_id, label, i - 1 AS word FROM (SELECT doc_id, label, t, unnest(range(1, len(t) + 1)) AS i FROM bt) WHERE starts_with(t[i], chr(1))),
bg AS (SELECT doc_id, count(*) AS n_base, min(word) AS first_word, max(word) AS last_word, list_sort(list(DISTINCT label)) AS names FROM bp GROUP BY 1),
ft AS (SELECT doc_id, label, level, score, {_places_sql('regex')} AS t FROM n, r WHERE regexp_matches(norm, ' (' || regex || ') ')),
fi AS (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM ft),
fs AS (SELECT DISTINCT doc_id, label, level, score, i - 1 AS start, (SELECT min(j) FROM (SELECT unnest(range(i, len(t) + 1)) AS j) WHERE ends_with(t[j], chr(2))) AS stop FROM fi WHERE starts_with(t[i], chr(1))),
kept AS (SELECT * FROM fs d WHERE NOT EXISTS (SELECT 1 FROM fs e WHERE e.doc_id = d.doc_id AND e.level <= d.level AND e.start <= d.start AND e.stop >= d.stop
  AND (e.start, -e.stop, e.level, e.label, e.score) < (d.start, -d.stop, d.level, d.label, d.score))),
kg AS (SELECT doc_id, list(DISTINCT label) AS names, max(score) AS score FROM kept GROUP BY 1)
SELECT n.doc_id, n_words::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(array_to_string(bg.names, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(coalesce(bg.names, []::VARCHAR[]) || coalesce(kg.names, []::VARCHAR[]))), ','), '') AS labels, greatest(CASE WHEN n_base > 0 THEN 0.95::DOUBLE ELSE 0.0::DOUBLE END, coalesce(kg.score, 0.0)) AS score
FROM n LEFT JOIN bg ON bg.doc_id = n.doc_id LEFT JOIN kg ON kg.doc_id = n.doc_id"""
