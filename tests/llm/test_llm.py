import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from conftest import DATA, same_rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from curvesmith.llm import bagminhash, bwtmerge, chat, decontaminate, kernels, langid, license_rules, licenses, linededup, mixing, neardup, queries, suffixdedup, topk, warc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


def docs(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    if extra:
        for c in ("score", "labels", "size", "id", "spans", "content", "kept", "lang_pred", "n_words", "_h", "taken"):
            df = df.withColumn(c, F.lit("clash"))
    return df


ODD = [
    (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\n", "en", "a", 5), (4, "x", "en", None, 1),
    (5, "Straße Ünïcode — 你好 \U0001f600 words here now", "de", "b", 9), (6, "same words in this line here\nsame words in this line here", "en", "b", 3),
    (7, "long " * 30000, "en", "b", 9), (8, "same words in this line here\nsame words in this line here", "en", "b", 3), (8, "same words in this line here\nsame words in this line here", "en", "b", 3), (None, "same words in this line here", "en", "a", 1),
]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, duck, name):
    same_rows(queries.QUERIES[name](spark, DATA), duck.sql(queries.SQL[name]))


# ------------------------------------------------------------- 1 licences


def brute_base(text):
    w, out = words(text), []
    for phrase, label in license_rules.BASE:
        p = phrase.split()
        out += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), out


def brute_labels(text):
    norm = " " + " ".join(words(text)) + " " if words(text) else ""
    found = []
    for k, r in enumerate(license_rules.rules()):
        if r["keyword"] in norm:
            for m in re.finditer(r["regex"], norm):
                a = norm[: m.start()].count(" ") - 1
                found.append((a, a + len(m[0].split()), r["level"], r["label"]))
    found = sorted(set(found), key=lambda f: (f[0], -f[1], f[2], f[3]))
    return {f[3] for k, f in enumerate(found) if not any(g[0] <= f[0] and g[1] >= f[1] and g[2] <= f[2] for g in found[:k])}


LICENSED = [
    (1, "Released under the MIT License. x under-the MIT/license", "", "", 0), (2, "Licensed under the Apache License, Version 2.0.", "", "", 0), (3, "CC BY-NC 4.0, cc by nc cc by nc", "", "", 0),
    (4, "This work is licensed under the GNU Lesser General Public License, version 2.1 and the GNU General Public License", "", "", 0),
    (5, "SPDX-License-Identifier: GPL-3.0-or-later", "", "", 0), (6, "submit license under the mit licenses", "", "", 0), (7, "permission is hereby granted, free of charge, to any person obtaining a copy", "", "", 0), *[(10 + i, *r[1:]) for i, r in enumerate(ODD)],
]


def test_licenses_against_brute_force(spark):
    got = {r.doc_id: r for r in licenses.scan_licenses(docs(spark, LICENSED, True)).collect()}
    assert len(got) == len(LICENSED)
    for i, t, *_ in LICENSED:
        n, base = brute_base(t)
        r = got[i]
        assert (r.n_words, r.n_base) == (n, len(base))
        assert (r.first_word, r.last_word) == ((min(base)[0], max(base)[0]) if base else (None, None))
        assert r.base_labels == ",".join(sorted({b for _, b in base}))
        assert r.labels == ",".join(sorted({b for _, b in base} | brute_labels(t)))
        assert 0 <= r.score <= 1
    assert len(license_rules.rules()) > 200
    assert licenses.scan_licenses(docs(spark, [])).count() == 0


# ------------------------------------------------------------- 2 lines


def test_line_dedup_against_brute_force(spark):
    rows = [(3, "a b c d e\nshort\nA  B c d E\nx y z w v", "", "", 0), (1, "first line of the text\na b c d e", "", "", 0), (9, None, "", "", 0), (5, "", "", "", 0), (4, "first line OF the text\n\nx y z w v", "", "", 0)]
    got = {r.doc_id: r for r in linededup.dedup_units(docs(spark, rows, True)).collect()}
    seen, want = set(), {}
    for i, t, *_ in sorted(rows):
        gone, at = [], 0
        for line in (t or "").split("\n") if t else []:
            k = " ".join(line.lower().split())
            if k:
                if k in seen:
                    gone.append((at, at + len(line)))
                seen.add(k)
            at += len(line) + 1
        want[i] = gone
    assert {i: [(s.start, s.end) for s in r.removed] for i, r in got.items()} == want
    assert got[4].kept == "" and got[3].kept == "short\nx y z w v" and got[9].kept is None
    assert linededup.dedup_units(docs(spark, ODD)).count() == len(ODD)
    assert linededup.dedup_units(docs(spark, [])).count() == 0


# ------------------------------------------------------------- 3 chat


def test_chat(spark):
    call = lambda *c: json.dumps({"tool_calls": list(c)})
    m = [
        (1, 0, "user", "Hi there"), (1, 1, "assistant", "Hello"), (1, 2, "user", "More"), (1, 3, "assistant", call({"id": "a", "name": "add", "arguments": {"y": 2, "x": 1}}, {"id": "b", "name": "add", "arguments": {"x": "no"}, "after": ["a"]}, {"id": "c", "name": "gone", "arguments": {}})),
        (1, 4, "tool", json.dumps({"tool_call_id": "a", "content": "3"})), (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "?"})),
        (2, 0, "assistant", call({"id": "p", "name": "add", "arguments": {"x": 1}, "after": ["q"]}, {"id": "q", "name": "add", "arguments": {"x": 1}, "after": ["p"]})), (3, 0, "user", None), (None, 0, "user", "x"), (4, 0, "tool", "not json"), (5, 1, "assistant", "{broken"),
    ]
    df = spark.createDataFrame(m, "conv_id bigint, turn bigint, role string, text string").withColumn("level", F.lit("clash"))
    schemas = {**chat.SCHEMAS, "add": {"required": ["x"], "additionalProperties": False, "properties": {"x": {"type": "integer"}, "y": {"type": "number", "maximum": 5}}}}
    got = {(r.conv_id, r.call_id, r.kind): r for r in chat.link(*chat.extracted(df), schemas).collect()}
    a = got[1, "a", "call"]
    assert a.linked and a.valid and a.level == 0 and json.loads(a.json)["result"] == "3"
    assert a.json == json.dumps(json.loads(a.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    b = got[1, "b", "call"]
    assert b.level == 1 and not b.valid and b.errors == "x: not integer" and not b.linked
    assert got[1, "c", "call"].errors == "unknown tool"
    assert got[1, "zz", "orphan"].linked is False
    assert got[2, "p", "call"].level is None and got[2, "q", "call"].level is None
    assert got[1, "turn-0", "call"].result_turn == 1 and got[1, "turn-2", "call"].level == 1
    assert got[3, "turn-0", "call"].errors == "text: minLength; words: minimum"
    assert chat.link(*chat.extracted(df.limit(0)), schemas).count() == 0


def test_levels_against_brute_force(spark):
    import random

    rng = random.Random(5)
    calls, needs = [], []
    for conv in range(12):
        n = 40 if conv else 300
        calls += [(conv, f"c{i}") for i in range(n)]
        for i in range(1, n):
            for _ in range(1 if conv == 0 else rng.choice([0, 1, 1, 1, 2, 3])):
                needs.append((conv, f"c{i}", f"c{i - 1 if conv == 0 else rng.randrange(i)}"))
    needs += [(3, "c1", "c5"), (3, "c5", "c1"), (4, "c2", "c2"), (5, "c3", "missing")]
    deps = {}
    for c, a, b in needs:
        if (c, b) in set(calls):
            deps.setdefault((c, a), set()).add((c, b))
    want, todo = {}, set(calls)
    while True:
        ready = {c for c in todo if all(d in want for d in deps.get(c, ()))}
        if not ready:
            break
        for c in ready:
            want[c] = 1 + max(want[d] for d in deps[c]) if deps.get(c) else 0
        todo -= ready
    got = chat.levels(spark.createDataFrame(calls, "conv_id bigint, call_id string"), spark.createDataFrame(needs, "conv_id bigint, call_id string, dep string"))
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == {c: want.get(c) for c in calls}


# ------------------------------------------------------------- 4 near duplicates


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    w1, w2 = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    x, w, d = np.concatenate([a, a[:250]]), np.concatenate([w1, w2[:250]]), np.repeat([0, 1], [300, 250])
    s = bagminhash.signatures(x, w, d, 2, 4096)
    w2 = np.where(np.arange(300) < 250, w2, 0)
    assert abs((s[0] == s[1]).mean() - np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()) < 0.03


def classes(rows, least=0.8):
    from collections import Counter

    bag, parent = {}, {}
    for k, (i, t, *_) in enumerate(rows):
        w = words(t)
        bag[k] = Counter(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else Counter()
        parent[k] = k

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in bag:
        for b in bag:
            if a < b and bag[a] and bag[b] and sum((bag[a] & bag[b]).values()) >= least * sum((bag[a] | bag[b]).values()):
                parent[root(a)] = root(b)
    group = {}
    for k, r in enumerate(rows):
        group.setdefault(root(k), []).append(r[0])
    return sorted((r[0] if r[0] is not None else -1, min((i for i in group[root(k)] if i is not None), default=-1)) for k, r in enumerate(rows))


def near_copies():
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(400)]
    rows, k = [], 0
    for base in range(6):
        t = list(rng.choice(vocab, 120))
        for c in range(12):
            u = list(t)
            for j in range(c % 4):
                u[(c * 37 + j * 11) % 120] = "changed"
            rows.append((k * 7 % 1009, " ".join(u), "", "", 0))
            k += 1
    return rows


def test_near_classes_against_brute_force(spark):
    rows = near_copies() + [(2000 + (r[0] or 0), *r[1:]) for r in ODD if r[0]] + [ODD[-1]]
    got = neardup.near_classes(docs(spark, rows, True)).collect()
    assert sorted((r.id if r.id is not None else -1, r.class_id if r.class_id is not None else -1) for r in got) == classes(rows)
    assert neardup.near_classes(docs(spark, [])).count() == 0


@pytest.mark.parametrize("parts", [1, 7])
def test_across_finds_clusters_in_blocks(spark, parts):
    sig = [bytes([k // 4] * 240) for k in range(20)]
    rows = [(1, k, k, parts, sig[k]) for k in range(20)] + [(2, 30 + k, 0, parts, sig[0]) for k in range(5)]
    df = spark.createDataFrame(rows, "band bigint, content bigint, root bigint, parts int, sig binary")
    groups = {}
    for r in neardup.across(df, 0.65).collect():
        groups.setdefault(r.cluster, set()).add(r.content)
    pairs = {(a, b) for g in groups.values() for a in g for b in g if a < b}
    assert pairs == {(a, b) for a in range(20) for b in range(a + 1, 20) if a // 4 == b // 4}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=12), min_size=1, max_size=14), st.integers(1, 12))
def test_shared_counts(texts, rare):
    from collections import Counter

    old, neardup.RARE, neardup.COLUMNS = (neardup.RARE, neardup.COLUMNS), rare, 2
    try:
        sh = np.array([x for t in texts for x in sorted(t)], np.uint64)
        got = neardup.shared_counts(sh, np.cumsum([0, *map(len, texts)]))
    finally:
        neardup.RARE, neardup.COLUMNS = old
    want = [[sum((Counter(a) & Counter(b)).values()) if i != k else 0 for k, b in enumerate(texts)] for i, a in enumerate(texts)]
    assert got.tolist() == want


def test_cluster_of_near_misses_sends_few_links(spark):
    """Sixty texts, each about 0.75 like every other: no pairs leave the task; with a ring of pairs at 0.8 added, links
    join the ring and no more."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for k in range(60):
        t = list(base)
        for at in rng.choice(400, 12, replace=False):
            t[at] = f"x{k}-{at}".replace("-", "q")
        rows.append((k, " ".join(t), "", "", 0))
        if k % 3 == 0:
            rows.append((100 + k, " ".join([*t[:-1], "end"]), "", "", 0))
    got = sorted((r.id, r.class_id) for r in neardup.near_classes(docs(spark, rows)).collect())
    assert got == classes(rows) and len({c for _, c in got}) == 60
    df = spark.createDataFrame([(1, r[0], r[0], r[1]) for r in rows], "cluster bigint, content bigint, root bigint, text string")
    assert neardup.joining(df, 5, 0.8).count() == 20


# ------------------------------------------------------------- 5 language


def test_language_id(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.trained_on(df)
    got = langid.identify(df, model).filter(langid.held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    odd = langid.identify(docs(spark, ODD, True), model).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in odd if r.text is None or not any(map(str.isalpha, r.text)))
    assert all(0 <= r.score <= 1 for r in odd) and len(odd) == len(ODD)
    assert langid.trained_on(docs(spark, [])) is None
    assert {r.lang_pred for r in langid.identify(docs(spark, ODD), None).collect()} == {"und"}


# ------------------------------------------------------------- 6 benchmark


def brute_hits(text, items, width=10):
    w, hit, ids = words(text), set(), set()
    for i, t in items:
        v = words(t)
        for k in range(max(1, len(v) - width + 1) if v else 0):
            p = v[k : k + width]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    ids.add(str(i))
    return len(w), hit, ids


def test_decontamination_against_brute_force(spark):
    q = "one two three four five six seven eight nine ten eleven twelve"
    items = [(7, q), (10, "Short item!"), (8, None), (9, ""), (11, "eight nine ten eleven twelve one two three four five")]
    rows = [(1, f"x {q.upper()}, y", "", "", 0), (2, "a short, item here. Short item", "", "", 0), (3, "two three four five six seven eight nine ten eleven twelve one two three four five", "", "", 0), *[(10 + k, *r[1:]) for k, r in enumerate(ODD)]]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (1 << 20, 40):
        got = {r.doc_id: r for r in decontaminate.decontaminate(docs(spark, rows, True), bench, spans=True, most=most).collect()}
        for i, t, *_ in rows:
            n, hit, ids = brute_hits(t, items)
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].contaminated) == (n, len(hit), len(ids), bool(hit))
            assert got[i].items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        s = got[1].hit_spans[0]
        assert rows[0][1][s.start : s.end] == q.upper()
    assert not any(r.contaminated for r in decontaminate.decontaminate(docs(spark, rows), bench.limit(0)).collect())


# ------------------------------------------------------------- 7 mix


def test_mix(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "w " * int(rng.integers(1, 60)), "", ["a", "b", "c", None][int(rng.integers(0, 8)) % 4 if i % 3 else 0], 0) for i in range(600)]
    got = mixing.mix(docs(spark, rows, True)).collect()
    by = {}
    for r in got:
        assert r.taken <= 2 * r.size
        x = by.setdefault(r.source, [0, r.target, r.source_size])
        x[0] += r.taken
    for taken, target, size in by.values():
        assert abs(taken - target) <= 60 and target <= 2 * size
    assert abs(sum(t for _, t, _ in by.values()) - 1.5 * sum(s for *_, s in by.values())) < 1e-6
    again = mixing.mix(docs(spark, rows).repartition(7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)
    assert mixing.mix(docs(spark, ODD)).count() == len(ODD) and mixing.mix(docs(spark, [])).count() == 0


# ------------------------------------------------------------- 8 WARC


def archive(n=5):
    out = b""
    for i in range(n):
        body = f"HTTP/1.1 200 OK\r\n\r\npage {i}".encode()
        out += (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}\r\nContent-Type: application/http\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
    return out


def test_salvage_plain():
    raw = archive()
    whole = list(warc.records(raw))
    assert [r["kind"] for r in whole] == ["record"] * 5
    cut = whole[2]["offset"]
    for bad in (raw[: cut + 4] + b"#" + raw[cut + 5 :], raw[:cut] + b"junk" * 9 + raw[cut:], raw[: cut + 200]):
        got = list(warc.records(bad))
        assert sum(r["length"] for r in got) == len(bad)
        ids = [r["record_id"] for r in got if r["kind"] == "record"]
        assert ids[:2] == ["<urn:page:0>", "<urn:page:1>"] and any(r["kind"] == "gap" and r["reason"] for r in got)
    broken = bytearray(raw)
    broken[whole[2]["offset"] + whole[2]["length"] - 6] ^= 1
    got = list(warc.records(bytes(broken)))
    assert [r["kind"] for r in got] == ["record", "record", "gap", "record", "record"] and got[2]["reason"] == "block digest differs"
    assert list(warc.records(b"")) == []


def test_salvage_members():
    parts = []
    for r in warc.records(archive()):
        z = zlib.compressobj(wbits=31)
        parts.append(z.compress(archive()[r["offset"] : r["offset"] + r["length"]]) + z.flush())
    assert len([r for r in warc.records(b"".join(parts)) if r["kind"] == "record"]) == 5
    parts[2] = parts[2][:-9] + b"\0" * 9
    got = list(warc.records(b"".join(parts)))
    assert len([r for r in got if r["kind"] == "record"]) == 4
    assert [r["offset"] for r in got if r["kind"] == "gap"] == [len(parts[0]) + len(parts[1])]


def test_warc_round_trip(spark, tmp_path):
    big = "<p>ü" * 60
    rows = [(1, "http://a", None), (2, "http://b\r\nX: 1", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (None, "n", "WARC/1.1\r\n\r\n" * 9), (7, "u", big)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit("clash"))
    for codec in ("none", "gzip"):
        path = str(tmp_path / codec)
        warc.write_warc(df, path, records_per_file=3, codec=codec)
        got = warc.read_warc(spark, path).collect()
        assert {r.kind for r in got} == {"record"} and len(got) == len(rows)
        by = {r.record_id: r for r in got}
        assert by["<urn:page:2>"].record_type == "response" and bytes(by["<urn:page:2>"].payload).decode() == big
        assert by["<urn:page:3>"].record_type == "revisit" and by["<urn:page:3>"].refers_to == "<urn:page:2>" and by["<urn:page:7>"].payload_bytes == len(big.encode())
        assert by["<urn:page:5>"].record_type == "response"
    assert warc.read_warc(spark, path).filter("kind = 'gap'").isEmpty()


def test_warc_has_one_response_for_each_payload(spark, tmp_path):
    a, b = "x" * 100, "y" * 99
    rows = [(5, "u", a), (5, "u", a), (None, "u", a), (7, "v", a), (None, "w", b), (None, "w", b), (1, "b", b), (None, "n", "z" * 200), (None, "n", "z" * 200), (9, None, "q" * (1 << 24)), (10, "r", "s" * (3 << 20))]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("revisit", F.lit("clash"))
    df.write.parquet(str(tmp_path / "pages.parquet"))
    for n in (warc.SMALL, 0):
        old, warc.SMALL = warc.SMALL, n
        try:
            got = warc.op8_warc(spark, str(tmp_path)).collect()
        finally:
            warc.SMALL = old
        key = lambda r: (r.payload_bytes, r.record_type, r.page_id or -1, r.refers_to or -1)
        want = [(99, "response", i, -1) for i in (1, -1, -1)] + [(100, "response", 5, -1), (100, "revisit", 5, 5), (100, "revisit", -1, 5), (100, "revisit", 7, 5), (200, "response", -1, -1), (200, "revisit", -1, -1), (1 << 24, "response", 9, -1), (3 << 20, "response", 10, -1)]
        assert sorted(map(key, got)) == sorted(want)


def test_warc_of_no_pages_and_lost_bytes(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "u", "a" * 500), (2, "u", "b" * 500)], "page_id bigint, url string, html string")
    df.limit(0).write.parquet(str(tmp_path / "empty" / "pages.parquet"))
    assert warc.op8_warc(spark, str(tmp_path / "empty")).collect() == []
    df.write.parquet(str(tmp_path / "two" / "pages.parquet"))
    monkeypatch.setattr(warc, "as_member", lambda record: b"junk")
    with pytest.raises(Exception, match="lost bytes"):
        warc.op8_warc(spark, str(tmp_path / "two")).collect()


# ------------------------------------------------------------- 9 top k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), [float(v) for v in rng.normal(size=6).round(1)]) for i in range(120)] + [(120, [1.0] * 6), (120, [1.0] * 6), (None, [1.0] * 6), (150, None), (200, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (201, [float("nan")] * 6), (202, [1.0]), (250, [float("inf")] * 6)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.nearest(df, lambda i: i % 50 == 0).collect() if r.vec_id is not None)
    good = [(k, i, np.floor(256 * np.array(v)).astype(int)) for k, (i, v) in enumerate(rows) if v and len(v) == 6 and None not in v and np.isfinite(v).all()]
    want = []
    for k, i, q in good:
        if i is not None and i % 50 == 0:
            s = sorted((-int(q @ v), -1 if j is None else j, n) for n, j, v in good if n != k)[:5]
            want += [(i, r + 1, j, -x) for r, (x, j, _) in enumerate(s) if j >= 0]
    assert got == sorted(want)
    assert topk.nearest(df.limit(0), lambda i: i % 50 == 0).count() == 0


@pytest.mark.parametrize("shape", ["many blocks", "long", "huge", "empty", "few"])
def test_top_k_of_odd_tables(spark, monkeypatch, shape):
    rng = np.random.default_rng(6)
    x = {
        "many blocks": rng.integers(-9, 9, (400, 4)), "long": rng.integers(-3, 3, (60, 900)), "huge": rng.integers(-(2**30), 2**30, (60, 3)) + 1,
        "empty": np.zeros((60, 0), int), "few": rng.integers(-9, 9, (3, 4)),
    }[shape]
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x.tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("score", F.lit("clash"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.nearest(df, lambda i: i % 20 == 0, scale=1.0).collect())
    want = []
    for i in range(0, len(x), 20):
        s = sorted((-sum(a * b for a, b in zip(map(int, x[i]), map(int, v), strict=True)), j) for j, v in enumerate(x) if j != i)[:5]
        want += [(i, r + 1, j, -v) for r, (v, j) in enumerate(s)]
    assert got == sorted(want)


def test_top_k_refuses_what_has_no_integer(spark):
    df = spark.createDataFrame([(0, [1e30]), (1, [1.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.nearest(df, lambda i: i % 50 == 0).collect()


# ------------------------------------------------------------- 10 suffixes


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if w in seen:
                hit[p : p + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        out[i] = (len(b), sum(hit), len(re.findall(b"\1+", bytes(hit))), hashlib.sha256(kept).hexdigest())
    return out


def passages():
    rng = np.random.default_rng(8)
    text = lambda n: "".join(rng.choice(list("abcdefgh é"), n))
    p, q = text(180), text(130)
    rows = [(k, text(60) + p[k % 40 :] + text(70) + (q if k % 3 == 0 else "") + text(20), "", "", 0) for k in range(40)]
    rows += [(100, None, "", "", 0), (101, "", "", "", 0), (102, "z" * 500, "", "", 0), (103, "ab" * 300, "", "", 0), (104, "z" * 150, "", "", 0), (105, rows[3][1], "", "", 0), (106, "x" * 99, "", "", 0), (107, "x" * 99, "", "", 0), (108, "x" * 100, "", "", 0)]
    return rows


@pytest.mark.parametrize("hot", [20_000, 4])
def test_suffix_dedup_against_brute_force(spark, hot):
    rows = passages()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(docs(spark, rows, True), hot=hot).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_odd_rows(spark):
    assert suffixdedup.dedup_substrings(docs(spark, ODD)).count() == len(ODD)
    assert suffixdedup.dedup_substrings(docs(spark, [])).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab", min_size=100, max_size=230), min_size=2, max_size=6), st.integers(1, 400))
def test_merged_transforms_find_all_repeats(texts, shard):
    old, bwtmerge.SHARD = bwtmerge.SHARD, shard
    try:
        at = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        s, off = bwtmerge.later_windows(np.frombuffer("".join(texts).encode(), np.uint8), at, np.arange(len(texts)), np.zeros(len(texts), np.int64))
    finally:
        bwtmerge.SHARD = old
    seen, want = set(), set()
    for i, t in enumerate(texts):
        for p in range(len(t) - 99):
            if t[p : p + 100] in seen:
                want.add((i, p))
            seen.add(t[p : p + 100])
    assert set(zip(s.tolist(), off.tolist(), strict=True)) == want


# ------------------------------------------------------------- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as c

    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(120)
    extra = [(9001, "123 456", "en", "src0", 7), (9002, None, "en", "src0", 0)]
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    item = bench.first().text
    extra.append((9003, f"Thing then the {item} and more of the", "en", "src1", 0))
    base = base.unionByName(spark.createDataFrame(extra, base.schema))
    base.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    rows = [tuple(r) for r in df.collect()]
    one = c.language_id(spark, df, str(tmp_path))
    assert one.columns == df.columns
    ids = {r.doc_id for r in one.collect()}
    assert ids == {r[0] for r in rows} - {9001, 9002}
    two = c.near_dedup(spark, df, str(tmp_path))
    assert sorted(r.doc_id for r in two.collect()) == sorted({c2 for _, c2 in classes(rows)})
    three = {r.doc_id: r for r in c.suffix_dedup(spark, df, str(tmp_path)).collect()}
    want = brute_repeats(rows)
    assert {i for i, r in three.items() if r.text is not None and r.n_chars < len(dict((x[0], x[1]) for x in rows)[i])} == {i for i, w in want.items() if w[1]}
    four = {r.doc_id for r in c.decontamination(spark, df, str(tmp_path)).collect()}
    items = [(r.item_id, r.text) for r in bench.collect()]
    assert four == {r[0] for r in rows if not brute_hits(r[1], items)[1]} and 9003 not in four
