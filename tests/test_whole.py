"""Queries cover all rows of their tables, not a part of them."""

import math

import numpy as np
import pytest

from curvesmith.functions import expr
from curvesmith.operators import gram, search, select
from curvesmith.plans import curves, decisions, fitting
from curvesmith.plans.estimator import FormulaRegressor

LARGER = "/root/testdata/sf0.01"


def test_basis_long_has_every_part(spark):
    parts = spark.read.parquet(f"{LARGER}/part.parquet")
    got = {(r.p_partkey, r.name): r.value for r in fitting.basis_long(spark, LARGER).collect()}
    rows = parts.select("p_partkey", "p_size", "p_retailprice").collect()
    assert len(rows) > 501 and len(got) == 6 * len(rows)
    for p in rows:
        s, v = p.p_size / 10, p.p_retailprice / 1000
        want = {"1": 1.0, "s": s, "v": v, "s*v": s * v, "s^2": s * s, "v^2": v * v}
        assert all(abs(got[p.p_partkey, k] - x) < 2e-6 for k, x in want.items())


@pytest.mark.parametrize("query", [curves.evolve_islands, curves.seed_search, decisions.beam_search])
def test_searches_score_on_all_rows(spark, query):
    items = spark.read.parquet(f"{LARGER}/lineitem.parquet").select("l_extendedprice", "l_discount").toPandas()
    x = {"x0": items["l_extendedprice"].to_numpy(float) / 1000, "x1": items["l_discount"].to_numpy(float)}
    y = x["x0"] - x["x0"] * x["x1"]
    rows = query(spark, LARGER).collect()
    assert rows
    for r in rows:
        e = np.mean((expr.to_numpy(expr.parse(r.formula), x) - y) ** 2)
        assert abs(r.mse - e) <= 1e-8 + 1e-9 * e if np.isfinite(e) else r.mse == np.inf


def test_search_samples_all_rows(spark):
    df = spark.range(20_000).selectExpr("id", "cast(id as double) as x", "cast(2 * id as double) as y")
    x, y = search.sampled(df, ["x"], "y")
    again, _ = search.sampled(df.repartition(7), ["x"], "y")
    assert len(y) == search.SAMPLE_ROWS and (y == 2 * x["x"]).all() and (again["x"] == x["x"]).all()
    assert np.abs(np.histogram(x["x"], 10, (0, 20_000))[0] - 200).max() < 70
    assert len(search.sampled(df.limit(50), ["x"], "y")[1]) == 50


def peeled(pairs):
    rank, rest, k = {}, set(pairs), 0
    while rest:
        front = {p for p in rest if not any(q != p and q[0] <= p[0] and q[1] <= p[1] for q in rest)}
        rank.update(dict.fromkeys(front, k))
        rest, k = rest - front, k + 1
    return rank


def test_ranks_of_all_fronts(spark):
    rows = [(i, (i * 7) % 6, float((i * i * 5) % 23)) for i in range(90)] + [(i, 3, float(i)) for i in range(100, 130)]
    odd = [(200, None, 1.0), (201, 1, None), (202, 1, float("nan"))]
    want = peeled([(a, b) for _, a, b in rows])
    got = select.ranks(spark.createDataFrame(rows + odd, "id int, a int, b double"), "a", "b").collect()
    assert sorted(r.id for r in got) == sorted(i for i, *_ in rows + odd)
    assert all(r["rank"] == (None if r.a is None or r.b is None or math.isnan(r.b) else want[r.a, r.b]) for r in got)
    assert max(want.values()) > 20


def test_nondominated_rank_has_every_candidate(spark):
    rows = {r.id: (r.complexity, r.mse) for r in curves._candidates(spark, LARGER).collect()}
    want = peeled(rows.values())
    got = curves.nondominated_rank(spark, LARGER).collect()
    assert {r.id: (r.complexity, r.mse, r["rank"]) for r in got} == {i: (*p, want[p]) for i, p in rows.items()}
    assert len(got) == len(rows)


def test_fit_finds_three_exact_terms(spark):
    df = spark.range(400).selectExpr("(id % 20) / 10.0D - 0.95D as x", "cast(floor(id / 20) as double) / 7 + 0.3D as z")
    model = FormulaRegressor().fit(df.selectExpr("x", "z", "0.004D * x * x * x + 2D * x * z - 3D * z * z as y"), ["x", "z"], "y")
    assert model.stage == "exact3" and model.mse < 1e-12 and model.candidates[0]["n_terms"] == 3


@pytest.mark.parametrize("planted", [(141, 3), (140, 7, 99)])
def test_exact_search_of_many_columns(planted):
    rng = np.random.default_rng(2)
    b = np.column_stack([np.ones(400), rng.normal(size=(400, 149))])
    y = b[:, planted] @ np.arange(1.0, len(planted) + 1)
    s = gram.Gram(b.T @ b, b.T @ y, float(y @ y), 400.0, np.ones(150))
    assert sorted(gram.exact_search(s, 1e-9)[0].terms) == sorted(planted)
