"""Byte-level BPE: texts to token ids by recursive queries over token positions, and ids back to bytes by an ordered aggregate."""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, returned, slices, table, utf8

#: A rank file of more bytes is refused: it is sent to all executors.
MOST_BYTES = 64 << 20
#: Bytes of text whose words are held at once; positions that one recursive query starts from, with all its rounds; words
#: whose ids a worker keeps, forgotten all at once beyond; tokens that one query decodes.
HELD_BYTES, ROUND_ROWS, KEPT_WORDS, DECODED = 4 << 20, 4 << 20, 400_000, 1 << 20
#: A round of the query costs a word's length and there are as many rounds: longer words (bytes) go through a heap of pairs.
LONG = 256

#: Rows (w, pos, tok, after) are words, places from 0, token ids and those of the next place. In each round a word's leftmost
#: pair of least rank becomes one token, at the second one's row; a word without a pair leaves. A token's id is its rank.
CONTRACT = """
WITH RECURSIVE s AS (
  SELECT w, pos, tok, after, 0 AS k FROM start
  UNION ALL
  SELECT t.w, (t.pos - (t.pos > f.pos)::INT)::INT, CASE WHEN t.pos = f.pos + 1 THEN f.id ELSE t.tok END,
    CASE WHEN t.pos = f.pos - 1 THEN f.id ELSE t.after END, t.k + 1
  FROM s t JOIN (
    SELECT w, (best & 65535)::INT AS pos, (best >> 16)::INT AS id FROM (
      SELECT w, min((m.id::BIGINT << 16) + pos) AS best FROM s JOIN merges m ON m.a = tok AND m.b = after GROUP BY w)
  ) f ON f.w = t.w
  WHERE t.pos <> f.pos)
SELECT s.w, pos, tok FROM s JOIN (SELECT w, max(k) AS k FROM s WHERE pos = 0 GROUP BY w) l ON s.w = l.w AND s.k = l.k
"""
DECODE = "SELECT d, unhex(array_to_string(list(hex ORDER BY pos), '')) AS bytes, count(*) AS n FROM coded JOIN tokens ON id = tok GROUP BY d ORDER BY d"


class Coder:
    """A vocabulary in DuckDB tables: tokens (id, hex) and merges (a, b, id), all pairs of tokens that make a third."""

    def __init__(self, lines: bytes, pattern: str):
        import duckdb
        import regex

        ranks = self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines.splitlines())}
        if missing := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"bytes without a token: {missing}")
        self.pattern = regex.compile(pattern)
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges = pa.table({c: pa.array([p[k] for p in pairs], pa.int32()) for k, c in enumerate(("a", "b", "id"))})
        tokens = pa.table({"id": pa.array(ranks.values(), pa.int32()), "hex": pa.array([t.hex() for t in ranks])})
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        for name, rows in (("merges", merges), ("tokens", tokens)):
            self.db.register("given", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.db.unregister("given")
        self.db.execute("CREATE TYPE hex AS ENUM (SELECT hex FROM tokens)")  # ordered as a number, not as a string
        self.db.execute("ALTER TABLE tokens ALTER hex TYPE hex")
        self.known: dict[str, bytes] = {}

    def query(self, sql: str, name: str, rows: pa.Table) -> pa.Table:
        self.db.register(name, rows)
        out = self.db.sql(sql).to_arrow_table()
        self.db.unregister(name)
        return out

    def contracted(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, as the bytes of 32-bit numbers. Words of like length go together, as rounds go by length."""
        size = np.array([len(w) for w in words], np.int64)
        by = np.argsort(size, kind="stable")
        out: list[bytes] = [b""] * len(words)
        for k in by[size[by] > LONG]:
            out[k] = self.by_heap(words[k])
        by = by[size[by] <= LONG]
        part = np.cumsum(size[by] ** 2) // ROUND_ROWS
        edges = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist() if len(by) else []
        for i, j in itertools.pairwise([*edges, len(by)]):
            some = by[i:j]
            data = np.frombuffer(b"".join([words[k] for k in some]), np.uint8)
            n = size[some]
            tok = self.first[data]
            after = np.append(tok[1:], np.int32(-1))
            after[np.cumsum(n) - 1] = -1
            start = pa.table({
                "w": np.repeat(np.arange(len(some), dtype=np.int32), n), "tok": tok, "after": after,
                "pos": (np.arange(len(data)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32),
            })
            last = self.query(CONTRACT, "start", start)
            w, pos, ids = (last.column(c).to_numpy() for c in ("w", "pos", "tok"))
            flat = ids[np.argsort(w.astype(np.int64) << 16 | pos)].tobytes()
            at = np.append(0, 4 * np.cumsum(np.bincount(w, minlength=len(some)))).tolist()
            for k, a, b in zip(some.tolist(), at[:-1], at[1:], strict=True):
                out[k] = flat[a:b]
        return out

    def by_heap(self, word: bytes) -> bytes:
        """The same for one long word: the leftmost pair of least rank is on top of a heap, and a list links what is left."""
        n, make = len(word), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n))  # a token's end, and where the token before starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := make(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)

        def offer(i: int) -> None:
            if i >= 0 and end[i] < n and (r := make(word[i : end[end[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[end[i]]))

        while heap:
            _, i, stop = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != stop:
                continue
            gone[end[i]] = 1
            end[i] = stop
            if stop < n:
                before[stop] = i
            offer(before[i])
            offer(i)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : end[i]]])
            i = end[i]
        return np.array(out, np.int32).tobytes()

    def learn(self, words: set[str]) -> None:
        """Makes the ids of all these words known. A word that is a token is that token, whatever its pairs would give."""
        new = list(words.difference(self.known))
        if len(self.known) + len(new) > KEPT_WORDS:
            self.known.clear()
            new = list(words)
        whole, rest = [w.encode("utf-8") for w in new], []
        for w, b in zip(new, whole, strict=True):
            if (r := self.ranks.get(b)) is not None:
                self.known[w] = r.to_bytes(4, "little")
            else:
                rest.append((w, b))
        self.known.update(zip([w for w, _ in rest], self.contracted([b for _, b in rest]), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if sum(map(len, texts)) > HELD_BYTES:  # one long text: by parts of its words
            out = []
            for t in texts:
                found, parts = self.pattern.finditer(t), []
                while words := [m.group() for m in itertools.islice(found, HELD_BYTES // 8)]:
                    self.learn(set(words))
                    parts.append(b"".join(map(self.known.__getitem__, words)))
                out.append(b"".join(parts))
            return out
        split = {t: self.pattern.findall(t) for t in dict.fromkeys(texts)}  # copies are split once
        self.learn(set().union(*split.values()))
        done = {t: b"".join(map(self.known.__getitem__, words)) for t, words in split.items()}
        return [done[t] for t in texts]

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        out = [b""] * len(sizes)
        if len(ids):
            pos = (np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
            rows = self.query(DECODE, "coded", pa.table({"d": np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), "pos": pos, "tok": ids}))
            if sum(rows.column("n").to_pylist()) != len(ids):
                raise ValueError("ids that are no token")
            for d, b in zip(rows.column("d").to_pylist(), rows.column("bytes").to_pylist(), strict=True):
                out[d] = b
        return out


def decoded_rows(c: Coder, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """The bytes of rows of `sizes` ids each, DECODED ids a query. A longer row is decoded in pieces: tokens are whole bytes."""
    pieces = np.maximum(-(-sizes // DECODED), 1)
    last = np.cumsum(pieces) - 1
    size = np.full(int(pieces.sum()), DECODED, np.int64)
    size[last] = sizes - (pieces - 1) * DECODED
    at, parts = np.append(0, np.cumsum(size)), []
    for i, j in slices(at, DECODED):
        parts += c.decode(ids[at[i] : at[j]], size[i:j])
    return [parts[k] if n == 1 else b"".join(parts[k - n + 1 : k + 1]) for k, n in zip(last.tolist(), pieces.tolist(), strict=True)]


_coders: dict[str, Coder] = {}


def coder(key: str, lines: bytes, pattern: str) -> Coder:
    """Made once in each Python worker, which keeps the words of its last partitions too."""
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(lines, pattern)
    return _coders[key]


def _sent(spark: SparkSession, path: str, pattern: str):
    """The rank file, read by the driver (a file of its own, or one that Spark's readers open) and sent to all executors."""
    if os.path.isfile(path):
        with open(path, "rb") as f:
            lines = f.read(MOST_BYTES + 1)
    else:
        file = spark.read.format("binaryFile").load(path).select("length", "content")
        if file.first()["length"] > MOST_BYTES:
            raise ValueError("the rank file is too long to be sent to executors")
        lines = bytes(file.first()["content"])
    if len(lines) > MOST_BYTES:
        raise ValueError("the rank file is too long to be sent to executors")
    key = hashlib.sha256(lines + pattern.encode()).hexdigest()
    return spark.sparkContext.broadcast((key, lines, pattern))


def _with(df: DataFrame, name: str, value) -> DataFrame:
    kept = [c for c in df.columns if c.lower() != name]
    return lean(df).select(*[F.col(f"`{c}`") for c in kept], value.alias(name))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text") -> DataFrame:
    """Adds `ids` (array of int) to every row: the tokens of its whole text by the ranks of the file at `path` (a token in
    Base64 and its rank a line), each match of `pattern` by itself, without special tokens. A null or empty text has no ids;
    rows given twice get the same each; a column of docs called ids, in upper or lower case, is replaced and all others are
    kept; an empty table gives an empty one. No shuffle. Words of a text are split by Python, HELD_BYTES of text at once;
    words that a worker does not know yet are contracted by one recursive query for many, words of over LONG bytes by a heap.
    """
    sent = _sent(docs.sparkSession, path, pattern)

    @F.arrow_udf("array<int>")
    def ids(text: pa.Array) -> pa.Array:
        c, out = coder(*sent.value), []
        _, at = utf8(text)
        for i, j in slices(at, HELD_BYTES):
            out += c.encode([t or "" for t in text.slice(i, j - i).to_pylist()])
        offsets = np.append(0, np.cumsum([len(x) // 4 for x in out]))
        flat = pa.array(np.frombuffer(b"".join(out), np.int32))
        returned()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)

    return _with(docs, "ids", ids(F.col(f"`{text_col}`")))


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """Adds `decoded` (binary) to every row: the bytes of its ids, from the ids alone. Null counts as no ids; an id that is no
    token, or null, is an error. Other columns, repeated rows and empty tables as in encode."""
    sent = _sent(coded.sparkSession, path, pattern)

    @F.arrow_udf("binary")
    def decoded(ids: pa.Array) -> pa.Array:
        c = coder(*sent.value)
        sizes = np.nan_to_num(pa.compute.list_value_length(ids).to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = ids.flatten()
        if flat.null_count:
            raise ValueError("an id is null")
        flat = flat.to_numpy()
        out = decoded_rows(c, flat, sizes)
        returned()
        return pa.array(out, pa.binary())

    # null becomes empty in the JVM; besides, a function of Python directly on encode()'s would have Spark encode twice
    ids = F.coalesce(F.col(f"`{ids_col}`"), F.array().cast("array<int>"))
    return _with(coded, "decoded", decoded(ids))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    return decode(coded, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.encode(F.array_join(F.col("ids").cast("array<string>"), ","), "utf-8"), 256).alias("ids_sha256"), F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
