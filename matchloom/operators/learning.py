"""Gradient-boosted match classifier on pair features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def assembled(table: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(table.fillna(0, features))


def train(table: DataFrame, features: list[str], rounds: int = 100, depth: int = 5, rate: float = 0.1, seed: int = 42) -> GBTClassificationModel:
    """A model of ``label`` on the rows whose split is train; rows of the split val, if any, stop the training early."""
    held = (F.col("split") == "val") if "split" in table.columns else F.lit(False)
    data = assembled(table, features).withColumn("held", held).withColumn("label", F.col("label").cast("double"))
    booster = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=rounds, maxDepth=depth, stepSize=rate, subsamplingRate=0.8,
        featureSubsetStrategy="0.8", minInstancesPerNode=5, maxBins=64, seed=seed, validationIndicatorCol="held",
    )
    if not data.where("held").limit(1).count():
        booster = booster.clear(booster.validationIndicatorCol) or booster
    return booster.fit(data)


def scored(model: GBTClassificationModel, table: DataFrame, features: list[str]) -> DataFrame:
    """The table with ``probability`` of a match."""
    out = model.transform(assembled(table, features))
    return out.withColumn("probability", vector_to_array("probability")[1]).drop("features", "rawPrediction", "prediction")


def importance(model: GBTClassificationModel, features: list[str], spark) -> DataFrame:
    rows = [(n, float(v)) for n, v in zip(features, model.featureImportances.toArray(), strict=True)]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(F.col("importance").desc(), "feature")
