"""Populations, splits, curve shapes and graphs on small tables, nulls and empty ones among them."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from curvesmith.functions import expr, graph
from curvesmith.operators import classify, features, gram, population


def test_blocks_of_features():
    x = np.linspace(0, 1, 200)
    at = lambda v, k: v[slice(*features.SCHEMA[k])]
    wave = features.features(np.sin(2 * np.pi * 5 * x))
    assert wave.shape == (features.WIDTH,) and np.isfinite(wave).all()
    assert at(wave, "raw").min() == 0 and at(wave, "raw").max() == 1
    assert np.argmax(at(wave, "fft")) == 5 and at(wave, "fft").max() == 1
    assert abs(at(wave, "stats")[0]) < 1e-9 and abs(at(wave, "stats")[1] - 1) < 1e-9
    line = features.features(3 * x + 2)
    assert np.allclose(at(line, "deriv")[:64], 1) and np.allclose(at(line, "raw"), np.linspace(0, 1, 128), atol=1 / 190)  # shares start at the first place's own
    for odd in ([], [1.0], [1.0, 2.0], [5.0] * 40, [1e300, -1e300, 0.0, 1.0], [float("nan")] * 12, [float("inf"), 1.0, 2.0]):
        assert np.isfinite(features.features(np.array(odd))).all() and len(features.features(np.array(odd))) == features.WIDTH


def test_more_curvature_draws_more_places():
    x = np.linspace(-1, 1, 300)
    y = np.abs(x) * 50  # bends at 0 only
    even, drawn = features.shape(y, pull=0.0), features.shape(y, pull=500.0)
    assert (drawn < 0.1).sum() > (even < 0.1).sum()


def test_shared_nodes():
    n = graph.node
    twice = {"nodes": [n("input", feature=0), n("input", feature=0), n("unary", op="periodic", omega=1.001, left=0), n("unary", op="periodic", omega=1.0, left=1), n("binary", op="division", left=2, right=3)], "weights": [0.0, 1.0, 2.0, 3.0, 4.0], "bias": 0.5}
    one = graph.shared(twice)
    assert [m["type"] for m in one["nodes"]] == ["input", "unary", "binary"] and one["weights"] == [1.0, 5.0, 4.0]
    assert (one["nodes"][2]["left"], one["nodes"][2]["right"]) == (1, 1) and not graph.check(one, 1)
    assert len(set(graph.digests(twice))) == 3


def test_one_tone_keeps_what_it_should():
    tone = lambda t: expr.show(expr.one_tone(expr.parse(t)))
    assert tone("x + 4*sin(3*x) + 0.1*sin(7*x)") == expr.canonical("x + 4*sin(3*x)")
    assert tone("4*sin(3*x) + 1*sin(7*x)") == "4*sin(3*x) + 1*sin(7*x)"
    assert tone("4*sin(x) + 0.1*sin(2*z)") == "4*sin(x) + 0.1*sin(2*z)"


def test_backward_prune():
    rng = np.random.default_rng(0)
    b = rng.normal(size=(4000, 4))
    y = 2 * b[:, 0] - b[:, 1] + 0.1 * rng.normal(size=4000)
    g, scale = b.T @ b, np.sqrt((b**2).mean(0))
    s = gram.Gram(g / np.outer(scale, scale), b.T @ y / scale, float(y @ y), 4000.0, scale, b.std(0))
    assert gram.backward_prune(s, gram._fit(s, range(4), "all")).terms == (0, 1)
    assert len(gram.backward_prune(s, gram._fit(s, range(4), "all"), tolerance=1e9, least=2.0).terms) == 1


def test_migration_without_explorers_or_fitness(spark):
    kind = "run int, name int, f double, e boolean"
    rows = spark.createDataFrame([(1, 1, None, False), (1, 2, 3.0, False), (1, 3, 4.0, False), (1, 4, 5.0, False), (1, 5, 1.0, True), (2, 1, 1.0, False), (None, 1, 2.0, False), (None, 2, 1.0, True)], kind)
    got = {(r.run, r.name, r.f, r.migrant) for r in population.migrated(rows, ["run"], "e", "f", "name").collect()}
    assert got == {(1, 5, 1.0, True), (1, 2, 3.0, False), (1, 3, 4.0, False), (1, 4, 5.0, False), (2, 1, 1.0, False), (None, 1, 2.0, False)}
    assert population.migrated(rows.limit(0), ["run"], "e", "f", "name").count() == 0


def test_draws_follow_weights(spark):
    rows = spark.range(4000).select(F.lit(1).alias("g"), "id", F.when(F.col("id") < 2000, 3.0).when(F.col("id") < 3999, 1.0).alias("w"))
    got = [r.id for r in population.drawn(rows, ["g"], "w", "id", 400).collect()]
    again = [r.id for r in population.drawn(rows.repartition(7), ["g"], "w", "id", 400).collect()]
    heavy = sum(i < 2000 for i in got)
    assert len(set(got)) == 400 and sorted(got) == sorted(again) and 260 < heavy < 340 and 3999 not in got


def test_split_keeps_shares(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 10 == 0).alias("rare"), F.lit(None).cast("int").alias("other"))
    out = population.stratified(rows, ["rare", "other"], "id", 0.2)
    assert {(r.rare, r.n) for r in out.filter("held_out").groupBy("rare").agg(F.count(F.lit(1)).alias("n")).collect()} == {(True, 20), (False, 180)}
    assert out.count() == 1000 and population.stratified(rows.limit(0), ["rare"], "id").count() == 0


def test_polynomial_degree_of_odd_groups(spark):
    rows = [("few", float(i), 1.0) for i in range(5)] + [("flat", float(i), 2.0) for i in range(30)] + [("cube", i / 3, (i / 3) ** 3 - i) for i in range(60)] + [("exp", i / 10, math.exp(i / 10)) for i in range(90)]
    rows += [("cube", None, 1.0), ("cube", 1.0, float("nan")), ("one", 3.0, 1.0)] + [("same", 1.0, float(i)) for i in range(20)]
    got = {r.k: (r.degree, r.polynomial) for r in population.polynomial_degree(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y").collect()}
    assert got["few"] == (0, False) and got["one"] == (0, False) and got["cube"] == (3, True) and not got["exp"][1] and not got["same"][1] and got["flat"] == (1, False)


@pytest.mark.parametrize("kind", ["logistic", "trees"])
def test_classes_are_learned(spark, kind):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    rows = spark.createDataFrame([(i, [float(a), float(b)], (["up"] if a > 0 else []) + (["right"] if b > 0.3 else [])) for i, (a, b) in enumerate(x)], "id int, f array<double>, classes array<string>")
    model = classify.fit(rows.filter("id < 400"), "f", "classes", ["up", "right", "never"], kind)
    out = model.transform(rows.filter("id >= 400")).collect()
    right = sum((r.predictions["up"] > 0.5) == ("up" in r.classes) and (r.predictions["right"] > 0.5) == ("right" in r.classes) for r in out)
    assert right > 180 and all(r.predictions["never"] == 0.0 for r in out)
