"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of 1 to 3 characters of the lower-cased text; tf is the share of a text's n-grams, idf comes
from document counts over all training documents. The model is fitted by follow-the-regularised-leader with elastic-net
penalties on a bounded sample, and its temperature on a part of that sample that the fit has not seen.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

#: Hash space of the n-grams.
SPACE = 1 << 16
ORDERS = (1, 2, 3)
#: At most about this many labelled documents are gathered to fit the model (the bound on the sample).
FIT_DOCS = 3000
#: Characters worked on at a time.
SLICE = 1 << 18
UNKNOWN = "und"
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


def ngrams(cp: np.ndarray) -> list[np.ndarray]:
    """Hashed n-grams that start at each character (code points), one array for each order."""
    out, h = [], np.zeros(len(cp), np.uint32)
    for k in range(max(ORDERS)):
        part = cp[k:] * _MIX[0] if k else cp * _MIX[0]
        h = h[: len(part)]
        h = (h ^ part) * _MIX[1]
        h ^= h >> np.uint32(15)
        if k + 1 in ORDERS:
            out.append((((h * _MIX[2]) >> np.uint32(16)) & np.uint32(SPACE - 1)).astype(np.int32))
    return out


def chars(text: str | None) -> np.ndarray:
    """Code points of the lower-cased text with a space at either end (so that n-grams know where words begin)."""
    return np.frombuffer(f" {(text or '').lower()} ".encode("utf-32-le", "replace"), np.uint32)


def batches_of(texts: list[str | None], most: int = SLICE):
    """(first row, code points of some rows one after another, where each begins). Two spaces part the rows, so no
    n-gram has characters of two of them; a text longer than `most` makes a slice of its own."""
    i = 0
    while i < len(texts):
        rows, held, j = [], 0, i
        while j < len(texts) and (not rows or held + len(texts[j] or "") <= most):
            rows.append(chars(texts[j]))
            held += len(rows[-1])
            j += 1
        yield i, np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        i = j


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def document_counts(texts: list[str | None]) -> np.ndarray:
    """How many of the texts hold each hashed n-gram."""
    total = np.zeros(SPACE, np.int64)
    for _, cp, at in batches_of(texts):
        grams = ngrams(cp)
        for i in range(0, len(at) - 1, 32):
            j = min(i + 32, len(at) - 1)
            seen = np.zeros((j - i, SPACE), bool)
            row = np.repeat(np.arange(j - i, dtype=np.int64) * SPACE, np.diff(at[i : j + 1]))
            flat = seen.reshape(-1)
            for g in grams:
                part = g[at[i] : at[j]]
                flat[row[: len(part)] + part] = True
            total += seen.sum(0)
    return total


@dataclass
class Model:
    langs: list[str]
    #: (SPACE, languages): weight times idf
    table: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        names, scores = [], []
        for i, cp, at in batches_of(texts):
            acc = np.zeros((len(cp), len(self.langs)), np.float32)
            grams = ngrams(cp)
            for g in grams:
                acc[: len(g)] += self.table[g]
            size = np.maximum(np.diff(at) * len(grams), 1)
            z = np.add.reduceat(acc, at[:-1], axis=0).astype(np.float64) / size[:, None] + self.bias
            p = softmax(z / self.temperature)
            best = p.argmax(1)
            for k, b in enumerate(best):
                ok = has_letter(texts[i + k])
                names.append(self.langs[b] if ok else UNKNOWN)
                scores.append(float(p[k, b]) if ok else 0.0)
        return names, scores


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def sparse(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams and their share of all n-grams of the text."""
    grams = np.concatenate(ngrams(chars(text)))
    idx, n = np.unique(grams, return_counts=True)
    return idx, n / max(len(grams), 1)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], langs: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, scale: float = 100.0, seed: int = 7) -> Model:
    """FTRL-proximal over the rows (n-grams, shares, language); a fifth of them sets the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    aside = order[: len(rows) // 5] if len(rows) >= 10 else order[:0]
    learn = order[len(aside) :]
    k = len(langs)
    z, n = np.zeros((SPACE + 1, k)), np.zeros((SPACE + 1, k))  # the last row is the bias
    x_of = lambda r: (np.append(r[0], SPACE), np.append(r[1] * idf[r[0]] * scale, 1.0))

    def weights(i):
        zi, ni = z[i], n[i]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for r in rng.permutation(learn):
            i, x = x_of(rows[r])
            w = weights(i)
            p = softmax(x @ w)
            p[rows[r][2]] -= 1
            g = x[:, None] * p
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    w = weights(np.arange(SPACE + 1))
    t = 1.0
    if len(aside):
        logits = np.array([x @ w[i] for i, x in (x_of(rows[r]) for r in aside)])
        truth = np.array([rows[r][2] for r in aside])
        # labels are softened by what so many rows can't tell, or a sample without errors would ask for no temperature
        soft = np.full(logits.shape, 1 / (len(truth) + 1) / k)
        soft[np.arange(len(truth)), truth] += 1 - 1 / (len(truth) + 1)
        nll = lambda t: -(soft * np.log(softmax(logits / t) + 1e-300)).sum(1).mean()
        lo, hi = math.log(0.05), math.log(20.0)
        for _ in range(40):  # golden section: the loss has one minimum in log t, or none inside
            a, b = lo + 0.382 * (hi - lo), lo + 0.618 * (hi - lo)
            lo, hi = (lo, b) if nll(math.exp(a)) < nll(math.exp(b)) else (a, hi)
        t = math.exp((lo + hi) / 2)
    return Model(langs, (w[:SPACE] * idf[:, None] * scale).astype(np.float32), w[SPACE], t)


def train(labelled: DataFrame, key: Column, text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> Model | None:
    """labelled: documents to learn from. idf counts all of them; the fit takes those whose digest of `key` is below a
    threshold set for about `fit_docs` rows. None if there is no labelled document."""
    labelled = lean(labelled).filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.lit("fit"), key), F.lit(1 << 20)).alias("draw"))

    def count(batches):
        total, docs = np.zeros(SPACE, np.int64), 0
        for b in batches:
            total += document_counts(b.column(0).to_pylist())
            docs += b.num_rows
        idx = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(idx, -1), pa.int32()), pa.array(np.append(total[idx], docs), pa.int64())], names=["gram", "n"])

    counts = labelled.select("text").mapInArrow(count, "gram int, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    df = np.zeros(SPACE + 1, np.int64)
    got = counts.toPandas()  # SPACE + 1 rows at most
    df[got["gram"].to_numpy()] = got["n"].to_numpy()
    n_docs = int(df[-1])
    if not n_docs:
        return None
    idf = np.log((1 + n_docs) / (1 + df[:-1])) + 0.1

    def features(batches):
        for b in batches:
            pairs = [sparse(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column(1), pa.array([p[0] for p in pairs], pa.list_(pa.int32())), pa.array([p[1].astype(np.float32) for p in pairs], pa.list_(pa.float32())), b.column(2),
            ], names=["lang", "grams", "share", "draw"])

    below = min(1 << 20, math.ceil((1 << 20) * fit_docs / n_docs))
    drawn = labelled.filter(F.col("draw") < below).mapInArrow(features, "lang string, grams array<int>, share array<float>, draw bigint")
    sample = drawn.toArrow().to_pydict()
    rows = sorted(zip(sample["draw"], sample["lang"], sample["grams"], sample["share"], strict=True), key=lambda r: (r[0], r[1], r[2]))
    langs = sorted(set(sample["lang"]))
    if not langs:
        return None
    number = {x: i for i, x in enumerate(langs)}
    return fit([(np.array(g, np.int64), np.array(s, np.float64), number[x]) for _, x, g, s in rows], langs, idf)


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score. A text that is null or has no letter is `und` with score 0, as is every text if there
    was nothing to learn from. Columns of docs that are called like ours are replaced."""
    from pyspark.sql import types as T

    docs = lean(docs).drop(*[c for c in ("lang_pred", "score") if c in docs.columns])
    names = docs.columns
    at = names.index(text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = sent.value
        for b in batches:
            texts = b.column(at).to_pylist()
            lang, score = model.predict(texts) if model else ([UNKNOWN] * len(texts), [0.0] * len(texts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def trained_on(docs: DataFrame) -> Model | None:
    return train(docs.filter(~held_out(F.col("doc_id"))), F.col("doc_id"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document without doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = identify(docs.select("doc_id", "text"), trained_on(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
