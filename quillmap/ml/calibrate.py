"""Isotonic calibration of scores."""

from __future__ import annotations

from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_isotonic(rows: DataFrame, label: str, score: str, increasing: bool = True, digits: int = 6) -> IsotonicRegressionModel:
    """An isotonic map from score to the share of positives.

    Rows combine first to one for each distinct score, rounded to ``digits``, weighted by how many there are: what the
    pooling works on is bounded by the number of distinct rounded scores, not by the rows.
    """
    points = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.round(F.col(score).cast("double"), digits).alias("x")).agg(
        F.avg(label).alias("y"), F.count(F.lit(1)).cast("double").alias("w")
    )
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=increasing, predictionCol="probability").fit(points)


def apply_isotonic(rows: DataFrame, model: IsotonicRegressionModel, score: str, out: str = "probability") -> DataFrame:
    """Scores beyond the fitted ones take the value at the end; between two, values are interpolated."""
    return model.transform(rows.withColumn("x", F.col(score).cast("double"))).drop("x").withColumnRenamed("probability", out)


def isotonic_table(rows: DataFrame, label: str, score: str) -> DataFrame:
    """The calibrated probability of each distinct integer score, falling as the score grows."""
    model = fit_isotonic(rows, label, score, increasing=False)
    return apply_isotonic(rows.select(F.col(score).cast("int").alias(score)).distinct(), model, score)
