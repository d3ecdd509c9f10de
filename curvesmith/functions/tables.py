"""Table functions: the long form of a term catalogue, called from SQL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from . import expr


def _listed(argument: AnalyzeArgument, what: str) -> list[str]:
    if not isinstance(argument.value, str) or not argument.value.strip():
        raise ValueError(f"{what}: a constant string, parted by semicolons")
    return [x.strip() for x in argument.value.split(";") if x.strip()]


#: Rows that are evaluated together.
HELD = 4096


@F.udtf
class LongBasis:
    """long_basis(TABLE(rows), 'k1; k2', 'x; x*y; sin(x)'): a row (keys as they are in the table, term_id, name, value) for
    each row and term. The schema follows from the arguments; formulas are parsed while the query is analysed, and a name that
    the table lacks or a formula that can't be read is an error then. A term with a null input is null."""

    @staticmethod
    def analyze(rows: AnalyzeArgument, keys: AnalyzeArgument, terms: AnalyzeArgument) -> AnalyzeResult:
        given = {f.name: f.dataType for f in rows.dataType.fields}
        named, formulas = _listed(keys, "keys"), _listed(terms, "terms")
        for f in formulas:
            unknown = expr.variables(expr.parse(f)) - set(given)
            if unknown:
                raise ValueError(f"{f}: the table has no {', '.join(sorted(unknown))}")
        if missing := [k for k in named if k not in given]:
            raise ValueError(f"the table has no {', '.join(missing)}")
        schema = T.StructType([T.StructField(k, given[k]) for k in named])
        return AnalyzeResult(schema.add("term_id", T.IntegerType()).add("name", T.StringType()).add("value", T.DoubleType()))

    def __init__(self):
        self.parsed, self.held = None, []

    def eval(self, row, keys: str, terms: str) -> Iterator[tuple]:
        if self.parsed is None:
            names = [x.strip() for x in terms.split(";") if x.strip()]
            self.parsed = [x.strip() for x in keys.split(";") if x.strip()], [(n, t, sorted(expr.variables(t))) for n in names for t in (expr.parse(n),)]
            self.used = sorted({v for _, _, inputs in self.parsed[1] for v in inputs})
        named, _ = self.parsed
        self.held.append((tuple([row[k] for k in named]), [row[v] for v in self.used]))
        if len(self.held) >= HELD:
            yield from self.flushed()

    def terminate(self) -> Iterator[tuple]:
        if self.held:
            yield from self.flushed()

    def flushed(self) -> Iterator[tuple]:
        """The rows that wait, all in one evaluation of each term."""
        held, self.held = self.held, []
        at = {v: [given[k] for _, given in held] for k, v in enumerate(self.used)}
        null = {v: np.array([x is None for x in xs]) for v, xs in at.items()}
        at = {v: np.array([np.nan if x is None else x for x in xs], float) for v, xs in at.items()}
        columns = []
        for name, tree, inputs in self.parsed[1]:
            values = np.broadcast_to(np.asarray(expr.to_numpy(tree, {v: at[v] for v in inputs}), float), len(held)).astype(object)
            for v in inputs:
                values[null[v]] = None
            columns.append((name, values.tolist()))
        for i, (own, _) in enumerate(held):
            for k, (name, values) in enumerate(columns):
                yield (*own, k, name, values[i])


def register(spark: SparkSession) -> None:
    spark.udtf.register("long_basis", LongBasis)
