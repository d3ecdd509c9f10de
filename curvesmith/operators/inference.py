"""Operators of curves as a Spark ML estimator: trained, calibrated, saved, loaded, and applied to slices of several inputs."""

from __future__ import annotations

import json

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel
from pyspark.ml.feature import StandardScalerModel
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate, classify

BINS = 20
KINDS = {"logistic": LogisticRegressionModel, "trees": GBTClassificationModel}


class _Columns(Params):
    features = Param(Params._dummy(), "features", "array of numbers", TypeConverters.toString)
    predictions = Param(Params._dummy(), "predictions", "map from class to probability", TypeConverters.toString)

    def __init__(self):
        super().__init__()
        self._setDefault(features="features", predictions="predictions")


class OperatorClassifier(_Columns, Estimator):
    """A model a class by classify.fit() on most rows, and for each class the isotonic rates of 20 bins of its score on the
    rest (a fifth, by a digest of the features). A class with fewer than ten positive or negative rows there keeps its scores.
    `classes` is the rows' column of class names, `names` are the classes in order."""

    def __init__(self, names: list[str], features: str = "features", classes: str = "classes", kind: str = "logistic", predictions: str = "predictions"):
        super().__init__()
        self.names, self.classes, self.kind = list(names), classes, kind
        self._set(features=features, predictions=predictions)

    def _fit(self, dataset: DataFrame) -> OperatorModel:
        f = self.getOrDefault(self.features)
        aside = F.pmod(F.xxhash64(f), F.lit(5)) == 0
        c = classify.fit(dataset.filter(~aside), f, self.classes, self.names, self.kind)
        scored = c.transform(dataset.filter(aside).filter(F.col(f).isNotNull()), "_p")
        each = scored.select(self.classes, F.explode("_p").alias("name", "score")).withColumn("label", F.coalesce(F.array_contains(self.classes, F.col("name")), F.lit(False)).cast("int"))
        b = F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).cast("int")
        counted = each.groupBy("name", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("positive")).collect()  # 20 rows a class
        rates = {n: calibrate.isotonic([(r["bin"], r["n"], r["positive"]) for r in counted if r["name"] == n]) for n in self.names}
        model = OperatorModel(c, rates, self.kind)
        model._set(features=f, predictions=self.getOrDefault(self.predictions))
        return model


class OperatorModel(_Columns, Model, MLWritable, MLReadable):
    def __init__(self, classifier: classify.Classifier, rates: dict[str, dict[int, float]], kind: str):
        super().__init__()
        self.classifier, self.rates, self.kind = classifier, rates, kind

    def _transform(self, dataset: DataFrame) -> DataFrame:
        """Adds the map from class to calibrated probability; null where the features are null."""
        out = self.getOrDefault(self.predictions)
        scored = self.classifier.transform(dataset, out)
        tables = {n: F.create_map(*[F.lit(x) for kv in sorted(t.items()) for x in kv]) for n, t in self.rates.items() if t}
        made = []
        for n in self.classifier.models:
            p = F.element_at(out, F.lit(n))
            b = F.greatest(F.least(F.floor(p * BINS), F.lit(BINS - 1)), F.lit(0)).cast("int")
            made += [F.lit(n), F.coalesce(F.try_element_at(tables[n], b), p) if n in tables else p]
        return scored.withColumn(out, F.when(F.col(out).isNotNull(), F.create_map(*made)))

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """about/ (JSON), scaler/ and models/0, 1, ... of the classes that aren't constants."""

    def __init__(self, model: OperatorModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        m, c = self.model, self.model.classifier
        about = {
            "features": m.getOrDefault(m.features), "predictions": m.getOrDefault(m.predictions), "kind": m.kind, "names": list(c.models),
            "constants": {n: v for n, v in c.models.items() if isinstance(v, float)}, "rates": {n: sorted(t.items()) for n, t in m.rates.items()},
        }
        self.sparkSession.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        c.scaler.save(f"{path}/scaler")
        for i, v in enumerate(c.models.values()):
            if not isinstance(v, float):
                v.save(f"{path}/models/{i}")


class _Reader(MLReader):
    def load(self, path: str) -> OperatorModel:
        about = json.loads(self.sparkSession.read.text(f"{path}/about").first()[0])
        kind = KINDS[about["kind"]]
        models = {n: about["constants"].get(n) if n in about["constants"] else kind.load(f"{path}/models/{i}") for i, n in enumerate(about["names"])}
        c = classify.Classifier(about["features"], StandardScalerModel.load(f"{path}/scaler"), models)
        model = OperatorModel(c, {n: {int(b): v for b, v in t} for n, t in about["rates"].items()}, about["kind"])
        model._set(features=about["features"], predictions=about["predictions"])
        return model


def over_inputs(scored: DataFrame, keys: list[str], predictions: str = "predictions") -> DataFrame:
    """Scores of the slices of one data set: each class as likely as in the slice where it is likeliest."""
    long = scored.select(*keys, F.explode(predictions).alias("_c", "_p")).groupBy(*keys, "_c").agg(F.max("_p").alias("_p"))
    return long.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_c", "_p")))).alias(predictions))
