"""Every pipeline stage, and run(), on odd tables and against brute force."""

import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_llm import ODD, brute_hits, brute_repeats, classes, docs, passages

import corpus_pipeline as c
from curvesmith.llm import mixing

CLASH = ("id", "h", "spans", "pack", "kept", "removed", "n_bytes", "hit_spans", "_hits", "_ids", "score", "lang_pred", "size", "n_words", "copies", "content", "root", "_gone", "_doc0", "_col0", "source_size", "weight", "u", "q", "bin")
BENCH = [(1, "a passage of the benchmark that has ten words or so in it"), (2, None)]


def odd(spark):
    long = "\n".join(f"das ist eine lange Zeile Nummer {i} mit vielen Worten darin" for i in range(3000))
    rows = [*ODD, (20, long, "de", "a", 1), (21, long, "de", "a", 1), (22, "The words of a passage of the benchmark that has ten words or so in it, then", "en", None, 1)]
    rows += [(30 + k, f"{k} this is plain English text about number {k} and its friends, of which there are {k * k}", "en", "b", 1) for k in range(12)]
    rows += [(60 + k, f"{k} das ist ein deutscher Text über Nummer {k} und ihre Freunde, von denen es {k * k} gibt", "de", "c", 1) for k in range(12)]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    spark.createDataFrame(BENCH, "item_id bigint, text string").withColumn("score", F.lit("clash")).write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.mark.parametrize("name", [n for n, _ in c.STAGES])
def test_stage_takes_any_columns(spark, folder, name):
    stage, plain = dict(c.STAGES)[name], odd(spark)
    wide = plain
    for k in CLASH:
        wide = wide.withColumn(k, F.concat(F.lit(f"{k} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    got = stage(spark, wide, folder)
    back = {k: f"{k}_before" if name == "source_mix" and k in c.MIXED else k for k in CLASH}
    rows = got.collect()
    assert rows and all(r[back[k]] == f"{k} of {'none' if r.doc_id is None else r.doc_id}" for r in rows for k in CLASH)
    assert name == "source_mix" or got.columns == wide.columns
    assert stage(spark, plain.limit(0), folder).count() == 0


def test_stages_on_repeated_rows_and_nulls(spark, folder):
    rows = [(1, "same text of five words", "en", "a", 1)] * 3 + [(None, "same text of five words", "en", "a", 1), (None, None, None, None, None), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]
    df = docs(spark, rows)
    assert sorted(map(str, (r.doc_id for r in c.near_dedup(spark, df, folder).collect()))) == ["1", "2", "None"]
    assert c.suffix_dedup(spark, df, folder).count() == len(rows) == c.decontamination(spark, df, folder).count()
    assert {r.doc_id for r in c.language_id(spark, df, folder).collect()} <= {1, None}


def brute_mix(rows, weights=(3, 1, 2)):
    """Words that each source's expected copies add up to, by bisection instead of a closed form."""
    import re

    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + size(r.text)
    names = sorted(total, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    lo, hi = 0.0, 4.0 * sum(total.values()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * total[s], mid * w[s]) for s in names) < 1.5 * sum(total.values()) else (lo, mid)
    return {s: min(2 * total[s], hi * w[s]) for s in names}, {id(r): size(r.text) for r in rows}


def test_source_mix_against_brute_force(spark, folder):
    df = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    rows = df.collect()
    target, size = brute_mix(rows)
    got = c.source_mix(spark, df, folder).collect()
    assert {r.doc_id for r in got} <= {r.doc_id for r in rows} and len({r.doc_id for r in got}) == len(got)
    for s, t in target.items():
        own = [r for r in got if r.source == s]
        assert all(r.copies in (1, 2) and r.taken == r.copies * r.size for r in own)
        assert abs(own[0].target - t) < 1e-6 * max(t, 1)
        assert abs(sum(r.taken for r in own) - t) <= max(size[id(r)] for r in rows if r.source == s)


def test_inclusion_odds_are_the_documents_own(spark):
    """A document is taken in proportion to the digits of its size."""
    rows = [(k, "w " * (1 if k % 2 else 100), "", "s" if k < 1500 else "t", 0) for k in range(3000)]
    took = {1: 0, 100: 0}
    for r in mixing.mix(docs(spark, rows), share=0.5).collect():
        took[r.size] += r.copies
    assert 6 < took[100] / max(took[1], 1) < 8  # 7 digits against 1


def test_run_against_brute_force(spark, tmp_path):
    """All stages in turn, each on what the one before kept."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(80)
    extra = [(5000 + r[0], r[1], "en", "src1", 0) for r in passages()[:12]] + [(9001, "123 456", "en", "src0", 7)]
    base = base.unionByName(docs(spark, extra))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stayed = {r.doc_id for r in c.language_id(spark, df, str(tmp_path)).collect()}
    rows = sorted(tuple(r) for r in df.collect() if r.doc_id in stayed)
    rows = [r for r in rows if r[0] in {k for _, k in classes(rows)}]
    gone = brute_repeats(rows)
    cut = []
    for r in rows:
        b, hit, seen = (r[1] or "").encode(), bytearray(len((r[1] or "").encode())), set()
        earlier = {w for s in rows if s[0] < r[0] for w in _windows(s[1])}
        for p in range(len(b) - 99):
            if b[p : p + 100] in earlier or b[p : p + 100] in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        assert sum(hit) == gone[r[0]][1]
        cut.append((r[0], bytes(x for x, h in zip(b, hit, strict=True) if not h).decode("utf-8", "ignore")))
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {i for i, t in cut if not brute_hits(t, items)[1]}
    text = dict(cut)
    got = c.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= want and all(r.text == text[r.doc_id] for r in got)
    source = {r.doc_id: r.source for r in df.collect()}
    left = spark.createDataFrame([(i, text[i], "", source[i], 0) for i in want], base.schema)
    alone = {(r.doc_id, r.copies, r.taken) for r in mixing.mix(left).filter("copies > 0").collect()}
    assert {(r.doc_id, r.copies, r.taken) for r in got} == alone


def _windows(text):
    b = (text or "").encode()
    return {b[p : p + 100] for p in range(len(b) - 99)}
