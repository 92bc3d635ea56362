"""Saving and loading fitted models: Spark's own as they are, boosted stumps as rows."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegressionModel
from pyspark.sql import SparkSession

from quillmap.ml.boost import Boosted, Stump


def save_boosted(spark: SparkSession, model: Boosted, path: str) -> None:
    rows = [(i, s.feature, s.threshold, s.left, s.right) for i, s in enumerate(model.stumps)]
    spark.createDataFrame(rows, "step int, feature int, threshold double, `left` double, `right` double").coalesce(1).write.mode("overwrite").parquet(path)


def load_boosted(spark: SparkSession, path: str) -> Boosted:
    rows = spark.read.parquet(path).orderBy("step").collect()
    return Boosted([Stump(r["feature"], r["threshold"], r["left"], r["right"]) for r in rows])


def save_model(model, path: str) -> None:
    """Any fitted Spark model, scaler or isotonic map."""
    model.write().overwrite().save(path)


def load_isotonic(path: str) -> IsotonicRegressionModel:
    return IsotonicRegressionModel.load(path)
