"""Operators lose nothing that the small tables happen not to have."""

import hashlib
import json
from collections import Counter

import numpy as np
import pytest
from test_llm import brute_repeats, passages

from curvesmith.llm import chat, linededup, suffixdedup, warc


@pytest.mark.parametrize("least", [1, 3])
def test_line_dedup_of_short_units(spark, least):
    rows = [(1, "all rights reserved.\nok\n\n中文没有空格的一行文字"), (2, "All rights  reserved.\nOK\n \n中文没有空格的一行文字"), (3, "\n\nok\nthe end")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = linededup.dedup_units(df) if least == 1 else linededup.dedup_units(df, least_words=least)
    seen, want = set(), {}
    for i, t in rows:
        gone, at = [], 0
        for line in t.split("\n"):
            k = tuple(line.lower().split())
            if len(k) >= least:
                if k in seen:
                    gone.append((at, at + len(line)))
                seen.add(k)
            at += len(line) + 1
        want[i] = gone
    assert {r.doc_id: [(s.start, s.end) for s in r.removed] for r in df.collect()} == want
    assert sum(map(len, want.values())) == (4 if least == 1 else 1)


def test_chat_loses_no_message(spark):
    one = {"name": "add", "arguments": {"x": 1}}
    m = [
        (1, 0, "system", "Be brief."), (1, 1, "tool", "not json"), (1, 1, "tool", "also not"), (1, 2, "tool", "[1, 2]"), (1, 3, "tool", json.dumps({"content": "no id"})),
        (2, 0, "assistant", json.dumps({"tool_calls": [one, {"name": "add", "arguments": {"x": 2}}, {**one, "after": ["a"]}, {**one, "id": "a"}]})),
        (3, 1, "assistant", '{"tool_calls": [{"id"'), (3, 2, "assistant", '{"tool_calls": {"id": "z"}}'), (3, 3, "assistant", '{"tool_calls": []}'), (3, 4, "assistant", '{"content": "Hi", "tool_calls": null}'),
        (4, 0, "developer", "odd"), (4, 1, None, "no role"),
    ]
    df = spark.createDataFrame(m, "conv_id bigint, turn bigint, role string, text string")
    rows = chat.formatted(df, {"add": {"required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()
    of = lambda conv, kind: sorted((r.turn, json.loads(r.json).get("result", json.loads(r.json).get("text"))) for r in rows if (r.conv_id, r.kind) == (conv, kind))
    assert of(1, "system") == [(0, "Be brief.")]
    assert of(1, "orphan") == [(1, "also not"), (1, "not json"), (2, "[1, 2]"), (3, "no id")]
    calls = [r for r in rows if r.conv_id == 2]
    assert sorted((r.level, json.loads(r.json)["arguments"]["x"], r.valid, r.linked) for r in calls) == [(0, 1, True, False), (0, 1, True, False), (0, 2, True, False), (1, 1, True, False)]
    assert len({r.call_id for r in calls} - {None}) == 4
    bad = {r.turn: r for r in rows if (r.conv_id, r.kind) == (3, "call")}
    assert {t: (r.errors, r.valid) for t, r in bad.items()} == {1: ("not JSON", False), 2: ("tool_calls: not array", False)}
    assert json.loads(bad[1].json)["text"] == m[6][3] and json.loads(bad[2].json)["arguments"] == {"tool_calls": {"id": "z"}}
    assert of(3, "orphan") == [(3, m[8][3]), (4, m[9][3])]
    assert of(4, "other") == [(0, "odd"), (1, "no role")]
    assert len(rows) == 15


def test_chat_rows_without_id_are_not_merged(spark):
    calls = spark.createDataFrame([(1, 0, None, "t", "{}"), (1, 0, None, "t", "{}"), (1, 1, None, "u", "{}"), (None, 0, "a", "t", "{}"), (None, 0, "a", "u", "{}")], "conv_id bigint, turn bigint, call_id string, tool string, args string")
    results = spark.createDataFrame([(1, 2, None, "x"), (1, 3, None, "y"), (None, 1, "a", "z")], "conv_id bigint, turn bigint, call_id string, content string")
    needs = spark.createDataFrame([], "conv_id bigint, call_id string, dep string")
    rows = chat.link(calls, results, needs, {"t": {}, "u": {}}).collect()
    assert Counter((r.conv_id, r.kind) for r in rows) == {(1, "call"): 3, (None, "call"): 2, (1, "orphan"): 2, (None, "orphan"): 1}
    assert not any(r.linked for r in rows)


def test_suffix_dedup_of_rows_given_twice_in_hot_leaders(spark):
    rows = [(i, t) for i, t, *_ in passages()]
    df = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id bigint, text string").coalesce(1)
    got = suffixdedup.dedup_substrings(df, hot=4).collect()
    assert len(got) == 2 * len(rows)
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == {(i, *v) for i, v in brute_repeats(rows).items()}


def test_suffix_dedup_fetches_nothing_for_a_common_gram(spark):
    rng = np.random.default_rng(5)
    text = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common, passage = text(45), text(110)
    rows = [(i, text(90) + common + text(90)) for i in range(60)] + [(100 + i, text(90) + passage + text(90)) for i in range(2)]
    df = spark.createDataFrame(rows, "id bigint, text string")
    met = suffixdedup.meet(suffixdedup.scan(df, 3), 3, 4).filter(f"kind <> {suffixdedup.REPEAT}").collect()
    assert {r.id for r in met} <= {100, 101}  # all sixty were dealt window by window
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(df.withColumnRenamed("id", "doc_id"), hot=4).collect()}
    assert got == brute_repeats(rows) and got[101][1] >= 110 and not any(got[i][1] for i in range(60))


@pytest.mark.parametrize("hot", [20_000, 6, 2, 1])
def test_suffix_dedup_of_parts_of_passages(spark, hot):
    rng = np.random.default_rng(11)
    text = lambda n: "".join(rng.choice(list("abcdé "), n))
    passage, rows = text(300), []
    for i in range(150):  # cut and changed anywhere, so that leaders stand at any distance from where equal bytes end
        a, n = int(rng.integers(0, 220)), int(rng.integers(60, 200))
        part = passage[a : a + n]
        if i % 3:
            at = int(rng.integers(0, len(part)))
            part = part[:at] + text(1 + i % 2) + part[at + 1 :]
        rows.append((i, text(int(rng.integers(0, 90))) + part + text(int(rng.integers(0, 90)))))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixdedup.dedup_substrings(df, hot=hot, bodies=False).collect()}
    assert got == brute_repeats(rows)


@pytest.mark.parametrize("damage", ["byte", "cut"])
def test_warc_salvages_before_the_damage(spark, tmp_path, damage):
    rows = [(i, f"http://{i}", "".join(hashlib.sha256(b"%d %d" % (i, k)).hexdigest() for k in range(40))) for i in range(30)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1), path)
    intact = lost = 0
    for f in (tmp_path / "w").glob("part-*"):
        raw = f.read_bytes()
        all_ = list(warc.records(raw))
        at = len(raw) // 2
        got = list(warc.records(raw[:at] if damage == "cut" else raw[:at] + bytes([raw[at] ^ 0xFF]) + raw[at + 1 :]))
        n = sum(r["kind"] == "record" for r in got)
        assert all(r in all_ for r in got if r["kind"] == "record") and [r["kind"] for r in got].count("gap") == 1
        intact, lost = intact + n, lost + len(all_) - n
    assert intact >= 10 and lost > 0
