"""Multi-label classification of feature vectors: one model a class, trained by Spark ML on standardised features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, StandardScalerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {
    "logistic": lambda: LogisticRegression(regParam=1e-3, maxIter=50),
    "trees": lambda: GBTClassifier(maxDepth=3, maxIter=8, stepSize=0.3, seed=7),
}


@dataclass
class Classifier:
    """Models of the classes; one that all or no rows had is a constant."""

    features: str
    scaler: StandardScalerModel
    models: dict

    def transform(self, rows: DataFrame, name: str = "predictions") -> DataFrame:
        """Adds a map from class to probability; columns of rows are kept, null features have no predictions."""
        out = self.scaler.transform(rows.withColumn("_v", F.when(F.col(self.features).isNotNull(), array_to_vector(self.features))).filter(F.col("_v").isNotNull()))
        got: dict[str, Column] = {}
        for i, (c, m) in enumerate(self.models.items()):
            if isinstance(m, float):
                got[c] = F.lit(m)
                continue
            m = m.setFeaturesCol("_s").setPredictionCol(f"_p{i}").setProbabilityCol(f"_q{i}").setRawPredictionCol(f"_r{i}")
            out = m.transform(out)
            got[c] = vector_to_array(F.col(f"_q{i}"))[1]
        known = out.select(*rows.columns, F.create_map(*[x for c, p in got.items() for x in (F.lit(c), p)]).alias(name))
        rest = rows.filter(F.col(self.features).isNull()).withColumn(name, F.lit(None).cast("map<string,double>"))
        return known.unionByName(rest)


def fit(rows: DataFrame, features: str, classes: str, names: list[str], kind: str = "logistic") -> Classifier:
    """A model for each name, of rows (features array<double>, classes array<string>) whose features are not null. The
    rows stay on the executors; a class that none or all of them have becomes a constant."""
    v = rows.filter(F.col(features).isNotNull()).select(array_to_vector(features).alias("_v"), classes)
    scaler = StandardScaler(inputCol="_v", outputCol="_s", withMean=True, withStd=True).fit(v)
    scaled = scaler.transform(v).select("_s", *[F.coalesce(F.array_contains(classes, n), F.lit(False)).cast("double").alias(f"_y{i}") for i, n in enumerate(names)])
    share = scaled.agg(*[F.avg(f"_y{i}").alias(f"s{i}") for i in range(len(names))]).first()
    models = {}
    for i, n in enumerate(names):
        s = share[f"s{i}"]
        models[n] = float(s or 0.0) if s in (None, 0.0, 1.0) else KINDS[kind]().setFeaturesCol("_s").setLabelCol(f"_y{i}").fit(scaled)
    return Classifier(features, scaler, models)
