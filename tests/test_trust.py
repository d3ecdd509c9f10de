import numpy as np
from pyspark.sql import functions as F

from curvesmith.operators import diagnostics, ranked, refine, routing, scorer
from curvesmith.sources import synthetic


def test_prior_trust(spark):
    rows = [(0.05, 0.45, False), (0.99, 0.0, True), (None, None, None), (float("nan"), 0.175, False), (-1.0, 9.0, False), (0.5, 0.35, True)]
    got = [r[0] for r in spark.createDataFrame(rows, "e double, m double, u boolean").select(routing.prior_trust(F.col("e"), F.col("m"), F.col("u"))).collect()]
    assert np.allclose(got, [0.95, 0.0, 1.0, 0.5, 1.0, 0.25])
    base = spark.createDataFrame([(0.7, t) for t in (0.0, 1.0, 2.0, 0.5)], "p double, t double")
    assert np.allclose([r[0] for r in base.select(routing.blended_prior(F.col("p"), F.col("t"), F.lit(4))).collect()], [0.25, 0.7, 0.7, 0.475])


def test_spectral_peaks(spark):
    rng = np.random.default_rng(1)
    data = [(k, i, float((np.sin(i) * 3 if k == 0 else 0) + rng.normal())) for k in (0, 1) for i in range(200)]
    data += [(2, i, 1.0) for i in range(9)] + [(3, i, None if i % 2 else 2.0) for i in range(30)] + [(4, 0, float("nan"))]
    got = {r.k: r for r in diagnostics.spectral_peaks(spark.createDataFrame(data, "k int, i int, e double").repartition(5), ["k"], "i", "e").collect()}
    assert set(got) == {0, 1, 2, 3} and got[0].structured and not got[1].structured and got[2].peak_ratio is None and got[3].n == 15
    for k in (0, 1):
        e = np.array([r[2] for r in data if r[0] == k])
        size = np.abs(np.fft.rfft(e - e.mean())[1:])
        assert np.isclose(got[k].peak_ratio, size.max() / np.median(size))


def test_ranks_equal_sorting(spark):
    rng = np.random.default_rng(2)
    data = [(g, i, float(v)) for g in ("a", None) for i, v in enumerate(np.round(rng.normal(size=300), 1))] + [("b", 0, 2.0), ("c", 0, None)]
    rows = spark.createDataFrame(data, "g string, i int, v double").repartition(6)
    got = {r.g: r for r in ranked.at_ranks(rows, ["g"], "v", {"first": F.lit(1), "tenth": F.lit(10), "last": F.col("_n")}).collect()}
    for g in ("a", None):
        s = sorted(r[2] for r in data if r[0] == g)
        assert (got[g].first, got[g].tenth, got[g]["last"], got[g]["_n"]) == (s[0], s[9], s[-1], 300)
    assert got["b"].tenth is None and got["b"]["last"] == 2.0 and "c" not in got
    ends = {(r.g, r.i): (r.low, r.high) for r in ranked.ends(rows, ["g"], "v", ["i"], F.lit(7)).collect()}
    assert len(ends) == len(data)
    for g in ("a", None):
        order = [(g, i) for i in sorted(range(300), key=lambda i: ([r[2] for r in data if r[0] == g][i], i))]
        assert {k for k in order if ends[k][0]} == set(order[:7]) and {k for k in order if ends[k][1]} == set(order[-7:])
    assert ends["c", 0] == (False, False)


def test_generated_curves_and_formulas(spark):
    rows = spark.createDataFrame([(1, 0.0, 1.0), (2, -1.0, 1.0), (3, None, 1.0)], "k int, lo double, a double")
    got = synthetic.curve_samples(rows, "a/x", F.col("lo"), F.lit(1.0), 3).collect()
    assert sorted((r.k, r.pos, r.x, r.y) for r in got) == [(1, 1, 0.5, 2.0), (1, 2, 1.0, 1.0), (2, 0, -1.0, -1.0), (2, 2, 1.0, 1.0)]
    keys = spark.createDataFrame([(i,) for i in (5, 1, 5, None)], "k int")
    a, b = ({(r.k, r.formula) for r in refine.formulas_for(keys.repartition(n), "k", 3).collect()} for n in (1, 3))
    assert a == b and len(a) == 3


def test_temperature_is_the_least(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=800) * 3
    y = (rng.uniform(size=800) < 1 / (1 + np.exp(-z / 2.5))).astype(int)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(z, y, strict=True)] + [(None, 1), (1.0, None)], "z double, y int")
    t, nll, n = scorer.fit_temperature(rows, "z", "y")
    loss = lambda t: np.mean(np.logaddexp(0, z / t) - y * z / t)
    assert n == 800 and np.isclose(nll, loss(t)) and loss(t) <= min(loss(t * 1.01), loss(t * 0.99)) and 1.8 < t < 3.5
    assert scorer.fit_temperature(rows.limit(0), "z", "y") == (1.0, None, 0)
    assert scorer.fit_temperature(rows.filter("z > 0").withColumn("y", F.lit(1)), "z", "y")[0] == scorer.COLDEST  # all right: no end to it


def test_best_thresholds(spark):
    data = [("a", 0.1, 0), ("a", 0.3, 1), ("a", 0.8, 1), ("a", None, 1), ("b", 0.9, 0), ("c", 0.4, 1), ("c", 0.4, 1), (None, 0.6, 1)]
    got = {r.k: r for r in diagnostics.best_threshold(spark.createDataFrame(data, "k string, s double, y int"), ["k"], "y", "s", [0.2, 0.4, 0.6]).collect()}
    assert (got["a"].threshold, round(got["a"].f1, 6), got["a"].positive) == (0.2, 0.8, 3)
    assert (got["b"].threshold, got["b"].f1) == (0.2, 0.0) and (got["c"].threshold, got["c"].f1) == (0.2, 1.0) and got[None].f1 == 1.0
