import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curvesmith.functions import graph
from curvesmith.operators import batched, cleanup, gram, slices
from curvesmith.plans import many, streams
from curvesmith.sources import shared
from curvesmith.sources.tables import sales
from curvesmith.streaming import trace


def cloud(n=500, k=3, seed=2):
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(size=(n, k)) * [1.0, 20.0, 0.1][:k], 3)


@pytest.mark.parametrize("k", [1, 2, 3])
def test_nearest_equals_all_pairs(spark, k):
    pts = cloud(k=k)
    pts[10:20] = pts[10]  # ties
    names = [f"x{i}" for i in range(k)]
    rows = spark.createDataFrame([(i, *map(float, p), float(i) / 7) for i, p in enumerate(pts)], "id long, " + ", ".join(f"{c} double" for c in names) + ", y double").repartition(5)
    at = np.vstack([cloud(60, k, 3), pts[10:11], np.full((1, k), 1e3)])
    got = {r.place: r for r in slices.nearest(rows, names, at, ["id"], ["y"]).collect()}
    assert sorted(got) == list(range(len(at)))
    for p, q in enumerate(at):
        d = ((pts - q) ** 2).sum(1)
        best = min(range(len(pts)), key=lambda i: (d[i], i))
        assert math.isclose(got[p].distance, math.sqrt(d[best]), rel_tol=1e-9, abs_tol=1e-12)
        assert math.isclose(d[got[p].id], d[best], rel_tol=1e-12, abs_tol=1e-15)


def test_slices_on_odd_rows(spark):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0), (2, 1.0, 2.0, 4.0), (3, None, 2.0, 5.0), (4, float("nan"), 1.0, 6.0)], "id long, a double, b double, y double")
    out = slices.slices(rows, ["a", "b"], "y", ["id"], 4).orderBy("input", "pos").collect()
    assert [(r.input, r.pos, r.id) for r in out] == [(c, p, 1) for c in "ab" for p in range(4)]
    assert slices.slices(rows.limit(0), ["a", "b"], "y", ["id"]).collect() == []
    got = slices.greatest(spark.createDataFrame([("c", "a", "sin", 0.2), ("c", "b", "sin", 0.7), ("c", "a", "exp", 0.1)], "curve string, input string, op string, p double"), ["curve"], "op", "p").collect()
    assert sorted((r.op, r.p) for r in got) == [("exp", 0.1), ("sin", 0.7)]


def test_batched_fits_equal_least_squares(spark):
    rng = np.random.default_rng(1)
    data = [(int(k), float(x), float(v)) for k in range(40) for x, v in zip(rng.uniform(-2, 2, 12), rng.normal(size=12), strict=True)]
    data += [(100, 1.0, 2.0), (101, None, 1.0), (102, float("nan"), 1.0)] + [(103, 1.5, float(i)) for i in range(9)]
    rows = spark.createDataFrame(data, "k long, x double, y double").repartition(6)
    terms = batched.pure_terms(F.col("x"), {"power", "periodic"})
    got = {r.k: r for r in batched.fit_each(rows, ["k"], terms, "y").collect()}
    assert set(got) == {*range(40), 100, 103} and got[100].weights is None and got[103].weights is None and got[103].formula is None
    for k in range(40):
        x, y = (np.array([r[i] for r in data if r[0] == k]) for i in (1, 2))
        b = np.column_stack([x, x**2, x**3, np.sin(x), np.cos(x), np.ones_like(x)])
        want = np.linalg.lstsq(b, y, rcond=None)[0]
        assert np.allclose(got[k].weights, want, rtol=1e-4, atol=1e-4)
        assert math.isclose(got[k].mse, float(((y - b @ want) ** 2).mean()), rel_tol=1e-6, abs_tol=1e-9)
    assert list(terms) == ["x", "x^2", "x^3", "sin(x)", "cos(x)", "1"] and "*sin(x)" in got[0].formula


def test_solved_systems():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(50, 6, 4)) * [1, 1e3, 1e-3, 1]
    g, c = np.einsum("nik,nij->nkj", a, a), rng.normal(size=(50, 4))
    w, ok = batched.solved(g, c)
    assert ok.all() and np.allclose(np.einsum("nij,nj->ni", g, w), c, rtol=1e-6, atol=1e-6)
    g[0, 1] = g[0, :, 1] = 0
    assert not batched.solved(g, c)[1][0]


def some_graphs():
    n = graph.node
    return [
        {"nodes": [n("input", feature=0), n("unary", op="power", left=0, p=1.5), n("unary", op="exp", left=0, omega=-1.0), n("binary", op="aggregation", left=1, right=2, tau=0.5), n("unary", op="log", left=3)], "weights": [1.0, 0.0, 0.0, 0.0, 2.0], "bias": 0.5},
        {"nodes": [n("input", feature=1), n("constant", value=2.0), n("binary", op="arithmetic", left=0, right=1, beta=2.0, gamma=1.0), n("unary", op="int_power", left=0, p=3.0), n("binary", op="division", left=2, right=3), n("unary", op="periodic", left=4, omega=2.0)], "weights": [0.0, 0.0, 1.0, 0.5, 0.0, 1.0], "bias": 0.0},
    ]


def test_arrays_equal_columns(spark):
    rows = spark.createDataFrame([(float(a), float(b)) for a in (-2, -0.5, 0, 1, 3) for b in (-1, 0, 0.5, 4)], "a double, b double")
    pdf = rows.toPandas()
    for g in some_graphs():
        want = rows.select(*[c.alias(f"n{i}") for i, c in enumerate(graph.node_columns(g, [F.col("a"), F.col("b")]))]).toPandas()
        for i, v in enumerate(graph.node_arrays(g, [pdf["a"].to_numpy(), pdf["b"].to_numpy()])):
            assert np.allclose(v, want[f"n{i}"], rtol=1e-9, atol=1e-12, equal_nan=True)


def test_cleaning_keeps_what_matters(spark):
    n = graph.node
    rows = spark.range(300).select((F.col("id") / 50.0).alias("a"), ((F.col("id") * 7 % 31) / 10.0).alias("b"))
    rows = rows.withColumn("y", 0.5 * F.col("a") + 2.0 * F.sin("b") + 3.0)
    g = {"nodes": [n("input", feature=0), n("input", feature=1), n("unary", op="periodic", left=1), n("unary", op="periodic", left=1, amplitude=4.0), n("unary", op="log", left=0), n("unary", op="exp", left=1, omega=0.1)], "weights": [0.4, 0.0, 1.0, 0.3, 0.2, 1e-9], "bias": 0.0}
    out, before, after = cleanup.clean_population(rows, ["a", "b"], "y", [g])[0]
    assert before > 0.1 and after < 1e-12 and out["bias"] == 3.0
    assert [x["type"] for x in out["nodes"]] == ["input", "input", "unary"] and out["weights"] == [0.5, 0.0, 2.0] and out["nodes"][2]["left"] == 1
    assert graph.check(out, 2) == []
    with pytest.raises(ValueError):
        cleanup.population_sums(rows, ["a", "b"], "y", [g] * 20_000)


def test_dead_nodes_on_odd_graphs(spark):
    schema = "id int, nodes array<struct<op:string,left:int,right:int>>, weights array<double>"
    rows = [(1, [("x", None, None), ("s", 0, None), ("m", 0, 1)], [0.0, 0.0, 1.0]), (2, [("x", None, None), ("s", 0, None)], [1.0, 0.0]), (3, [("x", None, None)], [0.0]), (4, [], []), (5, None, None)]
    got = {r.id: r for r in cleanup.without_dead(spark.createDataFrame(rows, schema)).collect()}
    assert got[1].live == [0, 1, 2] and got[2].live == [0] and got[3].live == [] and got[3].nodes == [] and got[4].live == []
    assert [tuple(x) for x in got[1].nodes] == rows[0][1] and got[2].weights == [1.0]


def test_sums_can_be_taken_apart():
    a = np.random.default_rng(0).normal(size=(30, 4))
    one = gram.Sums(a.T @ a)
    assert np.allclose((one + one - one).a, one.a) and one.columns([1]).k == 1


def test_stagnation_waits_for_late_points(spark, tmp_path):
    schema = "run string, at timestamp, v double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    day = lambda k: f"2024-01-{k:02d}T00:00:00Z"
    batches = [
        [("a", day(3), 5.0), ("a", day(1), 9.0), ("b", day(1), 1.0)],
        [("a", day(2), 7.0), ("a", day(6), 6.0), ("a", None, 1.0), (None, day(2), 1.0), ("a", day(4), None)],  # the second comes late, in time
        [("a", day(20), 8.0)],
        [("a", day(2), 0.0), ("b", day(30), 3.0)],  # too late to count
    ]
    import json
    import os

    for i, rows in enumerate(batches):
        p = tmp_path / "in" / f"{i}.json"
        p.write_text("\n".join(json.dumps(dict(zip(("run", "at", "v"), r, strict=True))) for r in rows))
        os.utime(p, (1_700_000_000 + i, 1_700_000_000 + i))
    out = trace.run_to_table(trace.ordered_stagnation(stream, "run", "at", "v", "5 days", 2, 1), str(tmp_path / "out"))
    got = sorted((r.run, r.at.day, r.best, r.since, r.stagnant, r.fires) for r in out.collect())
    assert got == [("a", 1, 9.0, 0, False, False), ("a", 2, 7.0, 0, False, False), ("a", 3, 5.0, 0, False, False), ("a", 6, 5.0, 1, False, False), ("a", 20, 5.0, 2, True, True), ("b", 1, 1.0, 0, False, False)]


def test_last_state_of_groups(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    got = trace.run_updates(stream, str(tmp_path / "out"), ["event_type"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, e.groupBy("event_type").count().collect()))


def test_folder_is_new_each_time(spark):
    assert shared.folder(spark, "a") != shared.folder(spark, "a")


def test_registered():
    assert set(many.SQL) == set(many.QUERIES) and set(streams.SQL) == set(streams.QUERIES)


def test_slices_shuffle_no_rows(spark):
    at = slices.places({"x0": (0.9, 105.0, 38.0), "x1": (0.0, 0.1, 0.05), "x2": (0.1, 5.0, 2.5)}, ["x0", "x1", "x2"])
    plan = slices.nearest(sales(spark, DATA), ["x0", "x1", "x2"], at, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], ["y"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    for spans in ([104.0, 0.1, 4.9], [0.0, 0.0], [1e9, 1.0], [1.0], [1.0] * 7):
        width, per = slices.cubes(spans)
        assert np.prod(per) <= slices.CELLS and all(w * width >= s * (1 - 1e-9) or w == slices.CELLS for w, s in zip(per, spans, strict=True))


@pytest.mark.parametrize("zone, kind", [("UTC", "int"), ("Asia/Tokyo", "string")])
def test_keys_of_stagnation_share_states(spark, tmp_path, zone, kind):
    """60 keys in 4 states, in several triggers: the rows of each key on its own, whatever the session's time zone."""
    start, hour = 1_704_067_200, 3600
    rows = [(k, start + (i * 7 + k) % 30 * hour + k % 3, float((i * 37 + k * 11) % 23)) for k in range(60) for i in range(25)]
    rows.sort(key=lambda r: r[1])
    for n in range(3):  # times of a file overlap with none of another
        part = [r for r in rows if (r[1] - start) // (10 * hour) == n]
        spark.createDataFrame(part, "k long, s long, v double").selectExpr(f"cast(k as {kind}) as k", "timestamp_seconds(s) as at", "v").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    zones = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        stream = spark.readStream.schema(f"k {kind}, at timestamp, v double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = trace.ordered_stagnation(stream, "k", "at", "v", "2 hours", buckets=4)
        q = out.writeStream.format("memory").queryName(f"shared_{kind}").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).start()
        q.awaitTermination()
        got = spark.table(f"shared_{kind}").selectExpr("cast(k as int) as k", "unix_seconds(at) as s", "best", "since", "stagnant", "fires").collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zones)
    assert 0 < max(o.numRowsTotal for p in q.recentProgress for o in p.stateOperators) <= 4
    want = []
    for k in range(60):
        best, since, rest = float("inf"), 0, 0
        for _, s, v in sorted(r for r in rows if r[0] == k and r[1] < rows[-1][1] - 2 * hour):
            best, since = (v, 0) if v < best else (best, since + 1)
            fires = since >= 5 and rest == 0
            rest = 3 if fires else max(0, rest - 1)
            want.append((k, s, best, since, since >= 5, fires))
    assert any(w[-1] for w in want) and sorted(map(tuple, got)) == sorted(want)
