"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, kept, scratch, table

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The places of a source's order are dealt to this many bins; only the bins around the cut are sorted.
BINS = 4096
#: A table of one row per source is broadcast if it has no more rows than this (some 10 MB); else it is joined by source.
SMALL = 100_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in [0, 1) from 52 bits of a digest: reruns agree, whatever the partitioning."""
    hexed = F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(key.cast("string"), F.lit("")))), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(2**52))


def targets(sizes: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) to (source, source_size, target): weights by rank of the source, a cap of `most` times
    its size, the excess reshared by weight. With sources in order of cap over weight, the level of the first source
    whose cap is not reached is closed-form, so nothing iterates. One row per source: the windows are over those."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = F.row_number().over(by_name) - 1
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (k % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", k.alias("k"), w.alias("w"))
    ranked = ranked.withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("k").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    led = ranked.select(
        "source", "source_size", "w", "cap",
        (F.lit(float(share)) * F.sum("source_size").over(every)).alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped"),
        F.sum("w").over(after).alias("open_w"),
    )
    led = led.withColumn("level", (F.col("total") - F.col("capped")) / F.col("open_w"))
    fits = F.col("level") * F.col("w") <= F.col("cap")
    level = F.min(F.when(fits, F.struct(F.col("capped"), F.col("level")))).over(every)["level"]
    full = F.least(F.col("cap"), F.coalesce(level * F.col("w"), F.col("cap")))
    return led.select("source", "source_size", full.alias("target"))


def weight_of(size: Column) -> Column:
    """The inclusion weight of a document: the binary digits of its size, so that words of long documents, which a target
    in words is made of, are somewhat likelier than those of scraps. It has few values, whatever the table."""
    return F.length(F.bin(size)).cast("long")


def levels_of(plan: DataFrame, most: float = 2.0) -> DataFrame:
    """plan (source, target, weight, s: the words of that weight) to (…, level): the factor by which weights become
    expected copies, least(most, level * weight), so that these give the source's target. Weights that reach the cap are
    the largest ones: of all prefixes of weights in descending order the first whose rest stays below the cap is it. Null
    if all do. A source has a row for each weight, some twenty."""
    down = Window.partitionBy("source").orderBy(F.desc("weight"))
    capped = F.coalesce(F.sum("s").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_ = F.sum(F.col("weight") * F.col("s")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.col("target") - F.lit(float(most)) * capped) / F.nullif(open_.cast("double"), F.lit(0.0))
    tried = plan.withColumns({"_level": level, "_capped": capped})
    fits = F.when((F.col("_level") >= 0) & (F.col("_level") * F.col("weight") <= F.lit(float(most))), F.struct("_capped", "_level"))
    return tried.groupBy("source").agg(F.min(fits)["_level"].alias("level"))


def small(df: DataFrame, n: int) -> DataFrame:
    """df, to be broadcast if its n rows are few."""
    return F.broadcast(df) if n <= SMALL else df


def ranked(sized: DataFrame, level: Column, most: float = 2.0) -> DataFrame:
    """Adds whole (certain copies), p (what is left of the expected copies: the inclusion probability of one more) and q:
    random odds over inclusion odds, the place in the Pareto order; null where there is nothing left to include."""
    expected = F.when(F.col("size") > 0, F.coalesce(F.least(F.lit(float(most)), level * F.col("weight")), F.lit(float(most)))).otherwise(F.lit(0.0))
    out = sized.withColumn("_expected", expected)
    out = out.withColumn("whole", F.floor("_expected").cast("long")).withColumn("p", F.col("_expected") - F.floor("_expected"))
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p")))
    return out.withColumn("q", F.when(F.col("p") > 0, q)).drop("_expected")


def pareto_plan(sized: DataFrame, most: float = 2.0, **how) -> DataFrame:
    """sized: (id, source, size, weight, u). Per source: size, target, level of expected copies, and the last key of the
    Pareto order that is still taken (none: null)."""
    words = cut(sized.groupBy("source", "weight").agg(F.sum("size").alias("s")))
    plan = targets(words.groupBy("source").agg(F.sum("s").alias("source_size")), most=most, **how)
    same = F.col("w.source").eqNullSafe(F.col("t.source"))
    level = levels_of(words.filter("s > 0").alias("w").join(plan.alias("t"), same).select("w.source", "target", "weight", "s"), most)
    plan = cut(plan.alias("t").join(level.alias("w"), same, "left").select("t.source", "source_size", "target", "level"))
    n = plan.count()
    met = sized.alias("k").join(small(plan.select("source", "level").alias("l"), n), F.col("k.source").eqNullSafe(F.col("l.source"))).select("k.*", "level")
    # the order's keys are dealt to bins of q / (1 + q), which lies in [0, 1); whole copies are taken first
    keyed = ranked(met, F.col("level"), most).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int"))
    bins = cut(keyed.groupBy("source", "bin").agg(F.sum(F.col("whole") * F.col("size")).alias("sure"), F.sum("size").alias("s")))
    sure = bins.groupBy("source").agg(F.sum("sure").alias("sure")).alias("a")
    need = plan.alias("t").join(sure, F.col("t.source").eqNullSafe(F.col("a.source"))).select("t.source", (F.col("target") - F.col("sure")).alias("need"))
    until = F.sum("s").over(Window.partitionBy("b.source").orderBy("bin"))
    at = bins.filter("bin is not null").alias("b").join(small(need.alias("p"), n), F.col("b.source").eqNullSafe(F.col("p.source")))
    at = at.select(F.col("b.source"), "bin", "s", "need", until.alias("until"))
    # the cut is in the last bin that begins before the need is met or, if that bin's first row is beyond it, at the end
    # of the one before
    begun = at.filter(F.col("until") - F.col("s") <= F.col("need"))
    last_two = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("bin")))
    edge = begun.withColumn("back", last_two).filter("back <= 2")
    edge = cut(edge.select("source", "bin", (F.col("until") - F.col("s")).alias("base"), "need"))
    near = keyed.alias("k").join(
        small(edge.alias("e"), 2 * n), F.col("k.source").eqNullSafe(F.col("e.source")) & (F.col("k.bin") == F.col("e.bin"))
    ).select(F.col("k.source").alias("source"), F.col("k.bin").alias("bin"), "base", "need", F.struct("q", "id", "size").alias("key"), "size")
    upto = F.col("base") + F.sum("size").over(Window.partitionBy("source", "bin").orderBy("key"))
    taken = near.withColumn("upto", upto).filter(F.col("upto") - F.col("size") / 2 <= F.col("need"))
    last = taken.groupBy("source").agg(F.max("key").alias("last_key"))
    return cut(
        plan.alias("p").join(last.alias("l"), F.col("p.source").eqNullSafe(F.col("l.source")), "left")
        .select(F.col("p.source").alias("source"), "source_size", "target", "level", "last_key")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", most: float = 2.0, **how) -> DataFrame:
    """Adds size, source_size, target, copies and taken to every document.

    A document's expected copies are its weight (weight_of) times a factor of its source, which is set so that they give
    the source's target in words; none has more than `most`. What is whole of them is taken for certain. The rest is the
    document's inclusion probability p, and one more copy is taken of those that come first in the source's Pareto order:
    random odds u/(1-u) over inclusion odds p/(1-p). The order is cut where the words taken come nearest to the target.
    u is a digest of id and seed (of the text, if the id is null), so reruns agree.

    A null or empty text has size 0 and is not taken; a null source is a source, after all others; rows with the same id,
    source and size stand or fall together; a long text is counted where it lies; an empty table gives an empty result;
    columns of docs that are called like ours are replaced.
    """
    own = ["size", "source_size", "target", "copies", "taken"]
    names = docs.columns
    apart = {c: f"_doc{k}" for k, c in enumerate(names)}  # so that no name clashes with one of ours
    ident, text, source = (apart[c] for c in (id_col, text_col, source_col))
    known = F.coalesce(F.col(ident).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    add = lambda df: df.withColumn("size", size_of(F.col(text))).withColumn("weight", weight_of(F.col("size"))).withColumn("u", uniform(known, seed))
    rows = docs.toDF(*apart.values())
    with scratch(docs.sparkSession):
        sized = cut(add(rows).select(F.col(ident).alias("id"), F.col(source).alias("source"), "size", "weight", "u"))
        plan = kept(pareto_plan(sized, most, **how))
    n = plan.count()
    met = add(rows).join(small(plan.withColumnRenamed("source", "_source"), n), F.col(source).eqNullSafe(F.col("_source")), "left")
    out = ranked(met, F.col("level"), most)
    more = F.when(F.col("p") > 0, F.struct("q", F.col(ident).alias("id"), "size") <= F.col("last_key"))
    out = out.withColumn("copies", F.col("whole") + F.when(F.coalesce(more, F.lit(False)), 1).otherwise(0)).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(*[F.col(apart[c]).alias(c) for c in names if c not in own], *own)


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY encode(source) ASC NULLS LAST) - 1 AS k FROM s),
c AS (SELECT *, [3, 1, 2][(k % 3 + 1)::INT] AS w, 2.0::DOUBLE * source_size AS cap FROM r),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE AS total,
        coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped,
        sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS open_w FROM c),
v AS (SELECT (total - capped) / open_w AS level FROM l WHERE (total - capped) / open_w * w <= cap ORDER BY capped, level LIMIT 1),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM v) * w, cap)) AS target FROM l),
x AS (SELECT source, length(bin(size)) AS weight, sum(size)::BIGINT AS s FROM d WHERE size > 0 GROUP BY 1, 2),
y AS (SELECT x.source, weight, coalesce(sum(s) OVER (PARTITION BY x.source ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS over_cap,
        target, (sum(weight * s) OVER (PARTITION BY x.source ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT::DOUBLE AS open_s
      FROM x JOIN t ON x.source IS NOT DISTINCT FROM t.source),
z AS (SELECT source, arg_min(level, over_cap) AS level FROM (SELECT *, (target - 2.0::DOUBLE * over_cap) / open_s AS level FROM y) WHERE level >= 0 AND level * weight <= 2.0 GROUP BY 1),
e AS (SELECT d.*, t.source_size, t.target, CASE WHEN size > 0 THEN coalesce(least(2.0::DOUBLE, level * length(bin(size))), 2.0::DOUBLE) ELSE 0.0::DOUBLE END AS e
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN z ON d.source IS NOT DISTINCT FROM z.source),
p AS (SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM e),
n AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS need, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q FROM p),
q AS (SELECT *, sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS FIRST, size) AS upto FROM n)
SELECT doc_id, size, source_size, target,
       ((whole + CASE WHEN p > 0 AND upto - size / 2 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM q
"""
