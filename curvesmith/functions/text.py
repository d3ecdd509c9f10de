"""Formula strings in columns: spelling, term counts, operator tags, numbers in them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr
from .expr import SPELLINGS


def normalised(text: Column) -> Column:
    for a, b in SPELLINGS.items():
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def term_count(text: Column) -> Column:
    """Terms of the outermost sum: signs that stand between two terms outside all parentheses, and one. Innermost
    parentheses are emptied until none is left; formulas nest less than ten deep."""
    flat = F.regexp_replace(text, r"\s+", "")
    for _ in range(10):
        flat = F.regexp_replace(flat, r"\([^()]*\)", "@")
    flat = F.regexp_replace(flat, r"[eE][+-](\d)", "$1")
    return F.when(flat == "", 0).otherwise(F.regexp_count(flat, F.lit(r"(?<=[\w@.|])[+-]")) + 1).cast("int")


def operator_tags(text: Column) -> Column:
    """Sorted, comma-joined families of operators in a formula."""
    has = {
        "exponential": r"exp\(|e\^", "log": r"(log|ln)\(", "periodic": r"(sin|cos|tan)\(", "power": r"\^|\*\*|sqrt\(", "rational": r"/",
    }
    return F.array_join(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in has.items()])), ",")


def model_size(text: Column) -> Column:
    """Operators and functions, and one."""
    return (F.regexp_count(text, F.lit(r"[-+*/^]")) + F.regexp_count(text, F.lit(r"[a-z]+\(")) + 1).cast("int")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?<![\w.])(\d+\.?\d*)"), F.lit(1)), lambda s: s.cast("double"))


def _each(text: Column, f, kind: str) -> Column:
    """A function of a formula's tree on Arrow batches, once for each different formula of a batch; null is null."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        known = {t: f(t) for t in v.dropna().unique()}
        return v.map(lambda t: known.get(t)).astype(object)

    return run(text)


def canonical(text: Column) -> Column:
    return _each(text, expr.canonical, "string")


def one_tone(text: Column) -> Column:
    """Formulas without the weak harmonics beside a strong one; what does not parse is null."""
    return _each(text, lambda t: None if (c := expr.canonical(t)) is None else expr.show(expr.one_tone(expr.parse(c))), "string")


def classes(text: Column) -> Column:
    """Sorted array of operator classes; empty for what does not parse."""
    return _each(text, lambda t: [] if expr.canonical(t) is None else sorted(expr.classes(expr.parse(t))), "array<string>")
