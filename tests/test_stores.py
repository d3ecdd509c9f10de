import os

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from curvesmith.functions import tables
from curvesmith.operators import inference
from curvesmith.plans import fitting
from curvesmith.sources import dataset


def some(spark, n=120):
    features = F.array(*[(F.col("id") * (k + 3) % 11 / F.lit(7.0)).cast("float") for k in range(5)])
    return spark.range(n).repartition(4).select(features.alias("features"), F.array((F.col("id") % 2).cast("float"), F.lit(1.0).cast("float")).alias("labels"), F.concat(F.lit("x + "), F.col("id").cast("string")).alias("formula"))


def rows_of(df):
    return sorted((tuple(r.features), tuple(r.labels), r.formula) for r in df.collect())


def test_dataset_comes_back(spark, tmp_path):
    dataset.register(spark)
    path, rows = str(tmp_path / "set"), some(spark)
    rows.write.format("curve_dataset").option("classes", "sin;exp").mode("append").save(path)
    got = spark.read.format("curve_dataset").load(path)
    assert rows_of(got) == rows_of(rows)
    assert got.rdd.getNumPartitions() == 4
    about = dataset.about(path)
    assert about["rows"] == 120 and about["feature_dim"] == 5 and about["operator_classes"] == ["sin", "exp"] and len(about["shards"]) == 4
    with np.load(f"{path}/{about['shards'][0]}") as z:
        assert z["features"].dtype == np.float32 and z["features"].shape[1] == 5
    rows.limit(3).write.format("curve_dataset").option("classes", "sin;exp").mode("append").save(path)
    assert spark.read.format("curve_dataset").load(path).count() == 123
    rows.limit(3).write.format("curve_dataset").option("classes", "sin;exp").mode("overwrite").save(path)
    assert spark.read.format("curve_dataset").load(path).count() == 3
    assert not [f for f in os.listdir(path) if f.startswith("_aside")]


def test_dataset_that_fails_leaves_nothing(spark, tmp_path):
    dataset.register(spark)
    path = str(tmp_path / "set")
    bad = some(spark).withColumn("labels", F.array(F.lit(1.0).cast("float")))
    with pytest.raises(Exception, match="label for each class"):
        bad.write.format("curve_dataset").option("classes", "sin;exp").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []
    some(spark).limit(0).write.format("curve_dataset").option("classes", "sin;exp").mode("append").save(path)
    assert spark.read.format("curve_dataset").load(path).count() == 0
    some(spark).write.format("curve_dataset").option("classes", "sin;exp").mode("append").save(path)
    with pytest.raises(Exception, match="other classes"):
        some(spark).write.format("curve_dataset").option("classes", "cos;exp").mode("append").save(path)
    assert spark.read.format("curve_dataset").load(path).count() == 120


@pytest.mark.parametrize("kind", ["logistic", "trees"])
def test_model_is_the_same_when_loaded(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    data = []
    for i in range(400):
        a = i % 2
        x = rng.normal(size=3) + [1.5 * a, 0, 0]
        data.append((i, x.tolist(), ["always", *(["sin"] if a else [])]))
    data.append((400, None, ["sin"]))
    rows = spark.createDataFrame(data, "id long, features array<double>, classes array<string>").cache()
    model = inference.OperatorClassifier(["sin", "always", "never"], kind=kind).fit(rows)
    assert model.rates["sin"] and not model.rates["always"]
    before = {r.id: r.predictions for r in model.transform(rows).collect()}
    model.write().overwrite().save(str(tmp_path / "model"))
    loaded = inference.OperatorModel.load(str(tmp_path / "model"))
    after = {r.id: r.predictions for r in loaded.transform(rows).collect()}
    assert after == before and before[400] is None and len(before) == 401
    assert all(p["always"] == 1.0 and p["never"] == 0.0 and 0 <= p["sin"] <= 1 for p in before.values() if p)
    right = np.mean([(before[i]["sin"] > 0.5) == bool(i % 2) for i in range(400)])
    assert right > 0.7
    by_two = loaded.transform(rows.filter("id < 10")).withColumn("k", F.floor(F.col("id") / 2))
    got = {r.k: r.predictions["sin"] for r in inference.over_inputs(by_two, ["k"]).collect()}
    assert got == {k: max(before[2 * k]["sin"], before[2 * k + 1]["sin"]) for k in range(5)}


def test_table_function(spark):
    tables.register(spark)
    part = spark.read.parquet(f"{DATA}/part.parquet").select("p_partkey", (F.col("p_size") / 10.0).alias("s"), (F.col("p_retailprice") / 1000.0).alias("v"))
    part.createOrReplaceTempView("own_part")
    got = spark.sql("SELECT * FROM long_basis(TABLE(own_part), 'p_partkey', '1; s; v; s*v; s^2; v^2')")
    assert got.schema.simpleString() == "struct<p_partkey:bigint,term_id:int,name:string,value:double>"
    want = fitting.basis_long(spark, DATA)
    a, b = (sorted((r.p_partkey, r.term_id, r.name, r.value) for r in df.collect()) for df in (got, want))
    assert [x[:3] for x in a] == [x[:3] for x in b] and np.allclose([x[3] for x in a], [x[3] for x in b], atol=1e-6)
    for keys, terms, what in (("p_partkey", "s + z", "has no z"), ("nothing", "s", "has no nothing"), ("p_partkey", "s +", "unexpected"), ("p_partkey", " ", "constant string")):
        with pytest.raises(Exception, match=what):
            spark.sql(f"SELECT * FROM long_basis(TABLE(own_part), '{keys}', '{terms}')").collect()
    spark.createDataFrame([(1, None), (2, 3.0)], "k int, s double").createOrReplaceTempView("own_odd")
    assert sorted((r.k, r.value) for r in spark.sql("SELECT * FROM long_basis(TABLE(own_odd), 'k', 's^2')").collect() if r.value) == [(2, 9.0)]


def test_table_function_evaluates_many_rows_at_once():
    one = tables.LongBasis.func()
    row = lambda i: {"k": i, "x": None if i % 5 == 0 else float(i)}
    n = tables.HELD + 7
    got = [list(one.eval(row(i), "k", "1; x^2")) for i in range(n)]
    assert [len(g) for g in got] == [0] * (tables.HELD - 1) + [2 * tables.HELD] + [0] * 7
    rows = [r for g in got for r in g] + list(one.terminate())
    assert rows == [r for i in range(n) for r in ((i, 0, "1", 1.0), (i, 1, "x^2", None if i % 5 == 0 else float(i * i)))]
    assert list(one.terminate()) == []
