"""Learners by Spark ML: boosted trees, seed ensembles, stages, out-of-fold scores, adversarial checks."""

from __future__ import annotations

import uuid

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.sampling import folds
from tidemark.sources.sinks import scratch, write_parquet


def focal(df: DataFrame, y: str, raw: str, gamma: float = 2.0, alpha: float = 0.25) -> DataFrame:
    """Gradient, (floored) Hessian and loss of the focal objective at raw scores."""
    p = 1 / (1 + F.exp(-F.col(raw)))
    pt = F.when(F.col(y) == 1, p).otherwise(1 - p)
    w = alpha * F.pow(1 - pt, F.lit(gamma))
    return df.withColumns({"grad": w * (p - F.col(y)), "hess": F.greatest(w * p * (1 - p), F.lit(1e-7)), "loss": -w * F.log(pt)})


def assembled(df: DataFrame, features: tuple[str, ...], y: str) -> DataFrame:
    """Features as one vector; nulls become 0. The label is a double."""
    d = df.na.fill(0.0, subset=list(features)).withColumns({c: F.col(c).cast("double") for c in features}).withColumn(y, F.col(y).cast("double"))
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(d)


def learner(kind: str, y: str, seed: int, weight: str | None = None, validation: str | None = None, trees: int = 10):
    """``gbt``: boosted trees, stopping on the validation rows if named; ``forest``: the second learner."""
    m = GBTClassifier(labelCol=y, maxIter=trees, maxDepth=4, seed=seed) if kind == "gbt" else RandomForestClassifier(labelCol=y, numTrees=trees, maxDepth=5, seed=seed)
    if weight:
        m = m.setWeightCol(weight)
    if validation and kind == "gbt":
        m = m.setValidationIndicatorCol(validation)
    return m


def stored(df: DataFrame) -> DataFrame:
    """A table that several models read: written once to the shared folder, not held in executors."""
    return df.sparkSession.read.schema(df.schema).parquet(write_parquet(df, f"training-{uuid.uuid4().hex}"))


def saved(model, spark: SparkSession, name: str) -> str:
    """Write a trained model to the shared folder; the path."""
    path = f"{scratch(spark)}/models/{name}"
    model.write().overwrite().save(path)
    return path


def importances(models: list, features: tuple[str, ...], spark: SparkSession) -> DataFrame:
    """(feature, seed, gain) of trained trees: one row a feature and model."""
    return spark.createDataFrame([(f, k, float(m.featureImportances[i])) for k, m in enumerate(models) for i, f in enumerate(features)], "feature string, seed int, gain double")


def predict(model, df: DataFrame, out: str) -> DataFrame:
    return model.transform(df).withColumn(out, vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def ensemble(train: DataFrame, test: DataFrame, y: str, kind: str = "gbt", seeds: tuple[int, ...] = (1, 2), **more) -> DataFrame:
    """The mean prediction of one model for each seed."""
    out = test
    for s in seeds:
        out = predict(learner(kind, y, s, **more).fit(train), out, f"__p{s}")
    mean = sum((F.col(f"__p{s}") for s in seeds), F.lit(0.0)) / len(seeds)
    return out.withColumn("score", mean).drop(*[f"__p{s}" for s in seeds])


def out_of_fold(df: DataFrame, y: str, k: int = 3, kind: str = "gbt", key: str = "event_id", trees: int = 5) -> DataFrame:
    """Each row scored by the model that has not seen its fold."""
    d = stored(folds(df, y, k, key=key))
    parts = [predict(learner(kind, y, f, trees=trees).fit(d.filter(F.col("fold") != f)), d.filter(F.col("fold") == f), "oof") for f in range(k)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
