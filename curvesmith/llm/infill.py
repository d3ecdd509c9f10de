"""Fill-in-middle: texts cut at token boundaries into prefix, middle and suffix, put in another order, and put back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, table

MARKS = ("<P>", "<S>", "<M>")
OWN = ("n", "form", "prefix_chars", "middle_chars", "output")


def boundaries(cp: np.ndarray) -> np.ndarray:
    """Ends of the tokens of a codepoint array, with 0 first. A token is white space and what follows it, or the white
    space at the end."""
    space = (cp == 32) | (cp - np.uint32(9) <= 4)
    return np.concatenate([[0], np.flatnonzero(~space[:-1] & space[1:]) + 1, [len(cp)]][: 3 if len(cp) else 1])


def pieces(text: str, h1: int, h2: int) -> tuple[int, str, str, str]:
    """Number of tokens, and the text cut after two of n + 1 boundaries, chosen by h1 and h2 modulo n + 1."""
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    at = boundaries(cp)
    n = len(at) - 1
    i, j = sorted((at[h1 % (n + 1)], at[h2 % (n + 1)]))
    return n, *(cp[a:b].tobytes().decode("utf-32-le") for a, b in ((0, i), (i, j), (j, len(cp))))


def _check(marks: tuple[str, str, str]) -> None:
    """What marks must hold so that the first mark found is the one that was put there: none is empty or the start of a
    mark is found inside one."""
    if len(set(marks)) != 3 or any(not m or any(m[k:].startswith(x) or x.startswith(m[k:]) for x in marks for k in range(1, len(m))) for m in marks) or any(a != b and a.startswith(b) for a in marks for b in marks):
        raise ValueError(f"marks overlap: {marks}")


def to_infill(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50, spm_rate: int = 80, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Adds n (tokens), form (plain, psm, spm), prefix_chars, middle_chars (codepoints; null if plain) and output to every
    row. `rate` percent of the texts are cut, `spm_rate` percent of these have the suffix first. Draws are the digest of
    seed and id alone, so partitioning, order and reruns have no say; rows given twice get the same result each. A null text
    counts as empty, a null id as the empty string; empty texts and texts that hold a mark stay plain. Columns of docs that
    are called like these five, in upper or lower case, are replaced, all others are kept. An empty table gives an empty one. No shuffle; one text at
    a time is held as codepoints (4 bytes each) in its task, whatever its length.
    """
    _check(marks)
    p, s, m = marks
    kept = [c for c in docs.columns if c.lower() not in OWN]
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = (text == "") | text.contains(p) | text.contains(s) | text.contains(m) | (h[2] % 100 >= rate)
    form = F.when(plain, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm")

    @F.arrow_udf("n long, prefix_chars long, middle_chars long, output string")
    def cut(text: pa.Array, form: pa.Array, h1: pa.Array, h2: pa.Array) -> pa.Array:
        n, pre, mid, out = [], [], [], []
        for t, f, a, b in zip(text, form.to_pylist(), h1.to_pylist(), h2.to_pylist(), strict=True):
            t = t.as_py()
            k, x, y, z = pieces(t, a, b)
            n.append(k)
            pre.append(None if f == "plain" else len(x))
            mid.append(None if f == "plain" else len(y))
            out.append(t if f == "plain" else p + x + s + z + m + y if f == "psm" else s + z + p + x + m + y)
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(pre, pa.int64()), pa.array(mid, pa.int64()), pa.array(out, pa.string())], ["n", "prefix_chars", "middle_chars", "output"])

    own = F.struct(cut(text, form, h[0], h[1]).alias("cut"), form.alias("form"))
    held = "_infill" + "_" * max(len(c) for c in docs.columns)  # no column is called like this
    out = lean(docs).select(*[F.col(f"`{c}`") for c in kept], own.alias(held))
    at = {"form": "form", **{c: f"cut.{c}" for c in OWN if c != "form"}}
    return out.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"{held}.{at[c]}").alias(c) for c in OWN])


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of to_infill was made of, from the output and its form alone: a plain expression."""
    _check(marks)
    p, s, m = marks

    def between(a: str, b: str | None) -> Column:
        begin = F.locate(a, output) + len(a)
        return F.substr(output, begin, F.locate(b, output) - begin) if b else F.substr(output, begin)

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = to_infill(table(spark, sf_dir, "documents").select("doc_id", "text"))
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id) AS h FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
  [('0x' || substr(h, 8 * k + 1, 8))::UBIGINT::BIGINT FOR k IN range(4)] AS g FROM t),
c AS (SELECT *, len(w)::BIGINT AS n, least(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS i, greatest(g[1] % (len(w) + 1), g[2] % (len(w) + 1)) AS j,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR g[3] % 100 >= 50 THEN 'plain' WHEN g[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, coalesce(array_to_string(w[1:i], ''), '') AS pre, coalesce(array_to_string(w[i + 1:j], ''), '') AS mid, coalesce(array_to_string(w[j + 1:], ''), '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
