"""All registered queries of the engine and the SQL that another engine can check them with."""

from __future__ import annotations

from .plans import catalogue, curves, decisions, fitting, many, populations, refinement, rules, scalar, streams

QUERIES = {**scalar.QUERIES, **fitting.QUERIES, **curves.QUERIES, **decisions.QUERIES, **streams.QUERIES, **catalogue.QUERIES, **rules.QUERIES, **populations.QUERIES, **refinement.QUERIES, **many.QUERIES}
SQL = {**scalar.SCALAR_SQL, **fitting.SQL, **curves.SQL, **decisions.SQL, **streams.SQL, **catalogue.SQL, **rules.SQL, **populations.SQL, **refinement.SQL, **many.SQL}
FLAGSHIP = "basis_gram"
