"""Fill-in-middle, byte BPE and periodic runs: against SQL, brute force, a library, and on odd rows."""

import random
import zlib

import numpy as np
import pytest
from conftest import DATA, same_rows
from pyspark.sql import functions as F

from curvesmith.llm import bpe, infill, periodic, queries

ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "a"), (4, "a"), (5, "x " * 30_000), (6, "漢字 的　是\x1c中 \x85b"), (7, "no <P> here"), (None, "one two three four"), (8, "a b " * 9 + "c"), (9, "é" * 700)]


def odd_rows(spark):
    return spark.createDataFrame([(i, t, [i or 0], f"n{i}") for i, t in ODD], "doc_id long, text string, extra array<long>, Form string")


@pytest.mark.parametrize("name", ["op11_infill", "op13_periodic_runs"])
def test_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name]))


def test_infill_comes_back(spark):
    for rate, spm in ((100, 50), (100, 100), (100, 0), (0, 50)):
        rows = infill.to_infill(odd_rows(spark), rate=rate, spm_rate=spm).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
        assert len(rows) == len(ODD)
        assert sorted((r.text or "", r.back) for r in rows) == sorted((t or "", t or "") for _, t in ODD)
        for r in rows:
            assert (r.form == "plain") == (r.prefix_chars is None) == (r.middle_chars is None)
            if not r.text or "<P>" in r.text or not rate:
                assert r.form == "plain" and r.output == (r.text or "")
            if rate == 100 and spm in (0, 100) and r.form != "plain":
                assert r.form == ("spm" if spm else "psm")
    r = next(x for x in infill.to_infill(odd_rows(spark), rate=100, spm_rate=0).collect() if x.doc_id == 8)
    assert r.output == f"<P>{r.text[:r.prefix_chars]}<S>{r.text[r.prefix_chars + r.middle_chars:]}<M>{r.text[r.prefix_chars:r.prefix_chars + r.middle_chars]}"
    assert r.text[: r.prefix_chars].count("a") + r.text[: r.prefix_chars].count("b") + r.text[: r.prefix_chars].count("c") == len(r.text[: r.prefix_chars].split())


def test_infill_marks_that_overlap(spark):
    for marks in (("<P>", "<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d"), ("", "b", "c")):
        with pytest.raises(ValueError):
            infill.to_infill(odd_rows(spark), marks=marks)


def test_boundaries():
    for text, want in (("", [0]), (" ", [0, 1]), ("a", [0, 1]), (" a b  ", [0, 2, 4, 6]), ("a　b c", [0, 3, 5])):
        assert infill.boundaries(np.frombuffer(text.encode("utf-32-le"), np.uint32)).tolist() == want


def test_long_rows_are_decoded_in_pieces(monkeypatch):
    _, _, c, _ = whole_vocabulary()
    monkeypatch.setattr(bpe, "DECODED", 5)
    texts = ["", "some words of a text that takes more than five tokens", "a", "漢字の文"]
    ids = [np.frombuffer(x, np.int32) for x in c.encode(texts)]
    assert [len(x) > 5 for x in ids] == [False, True, False, True] or len(ids[1]) > 5
    sizes = np.array([len(x) for x in ids])
    assert bpe.decoded_rows(c, np.concatenate(ids), sizes) == [t.encode() for t in texts]


def whole_vocabulary():
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        c = bpe.Coder(f.read(), p.PATTERN)
    return path, p.PATTERN, c, tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_bpe_equals_the_library():
    _, _, c, library = whole_vocabulary()
    rng = random.Random(7)
    tokens = list(c.ranks)
    texts = ["".join(rng.choice(rng.choice(["ab", "theing ando", "éèüß漢字", "-=_. \n", "0123456789", "a"])) for _ in range(rng.choice([0, 1, 30, 300]))) for _ in range(150)]
    texts += [b"".join(rng.choice(tokens) for _ in range(60)).decode("utf-8", "ignore") for _ in range(50)]
    texts += ["the" * 2000, "a" * 5000, " " * 3000 + "x"]  # words that are too long for the query
    got = [np.frombuffer(x, np.int32) for x in c.encode(texts)]
    assert [x.tolist() for x in got] == [library.encode_ordinary(t) for t in texts]
    assert c.decode(np.concatenate(got), np.array([len(x) for x in got])) == [t.encode() for t in texts]
    words = [t.encode() for t in texts if 2 <= len(t.encode()) <= bpe.LONG]
    assert c.contracted(words) == [c.by_heap(w) for w in words]


def test_bpe_in_parts_of_words(monkeypatch):
    _, _, c, library = whole_vocabulary()
    text = "some words, and others too: 123 don't 漢字 " * 40
    whole = c.encode([text])
    monkeypatch.setattr(bpe, "HELD_BYTES", 64)
    monkeypatch.setattr(bpe, "KEPT_WORDS", 5)
    assert c.encode([text]) == whole
    assert np.frombuffer(whole[0], np.int32).tolist() == library.encode_ordinary(text)


def test_bpe_odd_rows(spark):
    path, pattern, _, library = whole_vocabulary()
    out = bpe.decode(bpe.encode(odd_rows(spark), path, pattern), path, pattern)
    rows = out.collect()
    assert len(rows) == len(ODD) and {"extra", "Form"} <= set(out.columns)
    for r in rows:
        assert list(r.ids) == library.encode_ordinary(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
    empty = odd_rows(spark).limit(0)
    assert bpe.decode(bpe.encode(empty, path, pattern), path, pattern).collect() == []
    assert infill.to_infill(empty).collect() == [] and periodic.find_runs(empty).collect() == []
    with pytest.raises(Exception, match="no token"):
        bpe.decode(spark.createDataFrame([([60_000],)], "ids array<int>"), path, pattern).collect()


def test_bpe_query_equals_the_library(spark):
    import hashlib

    _, _, _, library = whole_vocabulary()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op12_byte_bpe"](spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def brute_runs(w):
    n, found = len(w), {}
    for p in range(n // 4, 0, -1):
        i = 0
        while i + p < n:
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i > s and i + p - s >= max(6, 4 * p):
                found[s, i + p - s] = p
            i += 1
    return sorted(((s, size, p) for (s, size), p in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            k, n, w = rng.randint(1, 4), rng.choice([0, 1, 5, 6, 7, 30, 120]), []
            while len(w) < n:
                c = rng.random()
                if c < 0.4 and w:
                    a = rng.randrange(len(w))
                    w += w[a : rng.randint(a, len(w))]
                elif c < 0.7:
                    w += [rng.randrange(k) for _ in range(rng.randint(1, 3))] * rng.randint(1, 7)
                else:
                    w.append(rng.randrange(k + 3))
            texts.append(np.array(w, np.int64))
        assert periodic.runs_of(texts) == [brute_runs(t.tolist()) for t in texts]


def test_previous_factors_equal_brute_force():
    rng = random.Random(4)
    for _ in range(100):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 60))]
        order, ranks = periodic.suffix_array(np.array(w))
        assert order.tolist() == sorted(range(len(w)), key=lambda i: w[i:])
        size, source = periodic.previous_factors(order, ranks)
        for i in range(len(w)):
            want = max([sum(1 for _ in iter_same(w, j, i)) for j in range(i)], default=0)
            assert size[i] == want and (not want or sum(1 for _ in iter_same(w, int(source[i]), i)) >= want and source[i] < i)


def iter_same(w, i, j):
    while j < len(w) and w[i] == w[j]:
        yield i
        i, j = i + 1, j + 1


def test_runs_odd_rows(spark, monkeypatch):
    out = periodic.find_runs(odd_rows(spark), tail=F.crc32(F.col("doc_id").cast("string").cast("binary")))
    rows = out.collect()
    assert len(rows) == len(ODD) and {"extra", "Form", "text"} <= set(out.columns)
    for r in rows:
        words = (r.text or "").encode().split()
        at = periodic.planted(len(words), zlib.crc32(str(r.doc_id).encode())) if r.doc_id is not None else None
        words = words if at is None else [words[i] for i in at]
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == brute_runs(words)
        dropped = {i for s, size, p in r.runs for i in range(s + p, s + size)}
        assert r.collapsed == b" ".join(w for i, w in enumerate(words) if i not in dropped).decode()
    long = next(r for r in rows if r.doc_id == 5)
    assert [tuple(x) for x in long.runs] == [(0, 30_000, 1)] and long.collapsed == "x"
