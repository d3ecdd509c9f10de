"""The corpus pipeline: five stages over the documents table, each on all that the one before it kept.

Every stage takes any columns besides those that it reads, whatever their names, and returns them as they came (the last
adds its own: a column of documents that is called like one of those comes back as `<name>_before`). An empty table gives
an empty one; nulls, ties and repeated rows are said at each stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curvesmith.llm import decontaminate, langid, mixing, neardup, suffixdedup
from curvesmith.llm.common import kept, scratch, stored, table

#: Documents whose best language is less likely than this are rejected, as are those without a letter.
LEAST_SCORE = 0.5


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns renamed so that no operator has one of that name, and the new names by the old ones."""
    names = {c: f"_col{k}" for k, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def back(names: dict[str, str]) -> list[Column]:
    return [F.col(new).alias(old) for old, new in names.items()]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; a null, empty or letterless text goes. Learns from the rows of docs with a
    language; if there are none, no language is known and all go. A row given twice stays or goes twice."""
    model = langid.trained_on(docs.select("doc_id", "text", "lang"))
    rows, names = apart(docs)
    named = langid.identify(rows, model, names["text"])
    return named.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*back(names))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the smallest doc_id, once if it was given twice. A null doc_id stays only
    if its class has no other; texts without words are alone in their class, but for rows with the same doc_id."""
    odd = not docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty()
    rows, names = apart(docs.dropDuplicates(["doc_id", "text"]) if odd else docs)
    key, text = names["doc_id"], names["text"]
    if odd:  # ids that several rows share tell no rows apart: number them
        key = "_row"
        rows = stored(rows.orderBy(F.col(names["doc_id"]).asc_nulls_last(), F.xxhash64(text)).withColumn(key, F.monotonically_increasing_id()), "numbered")
    gone = stored(neardup.near_classes(rows, key, text).filter("id <> class_id").select("id"), "gone")
    return rows.join(gone, rows[key] == gone["id"], "left_anti").select(*back(names))


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the passages that occur earlier; characters that a cut parted are dropped. n_chars follows
    the text; a null text stays null, an empty one empty. Rows given twice lose the same passages each."""
    rows, names = apart(docs)
    cut = suffixdedup.decoded(suffixdedup.dedup_substrings(rows, names["doc_id"], names["text"]))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return cut.select(*[new.get(old, F.col(col)).alias(old) for old, col in names.items()])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window; null and empty texts have none and stay, as do all if the benchmark is
    empty. A row given twice stays or goes twice."""
    rows, names = apart(docs)
    out = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), names["text"])
    return out.filter(~F.col("contaminated")).select(*back(names))


#: What the last stage adds.
MIXED = ("size", "source_size", "target", "copies", "taken")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with how often and how many words. A null source is one, after all others; empty
    texts have no words, and stay where whole copies are taken."""
    rows, names = apart(docs)
    mixed = mixing.mix(rows, names["doc_id"], names["text"], names["source"]).filter("copies > 0")
    old = {f"{c}_before" if c in MIXED else c: col for c, col in names.items()}
    return mixed.select(*back(old), *MIXED)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]
#: Signatures and merged transforms are not SQL; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents through all stages; each stage's rows are a table in the shared folder, the last one's is returned."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):
            docs = kept(stored(stage(spark, docs, sf_dir), f"stage-{name}"))
    return docs
