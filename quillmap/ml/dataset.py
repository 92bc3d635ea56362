"""Feature tables as training data, and the report of a fitted model."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import MinMaxScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators import metrics
from quillmap.operators.sampling import stratified_split

#: Features of the scripts' usual choice.
DEFAULT_FEATURES = [
    "mapq", "insert_size", "edit_distance", "mismatches", "gap_opens", "alignment_score", "secondary_alignment_score", "pair_orientation", "pair_alignment_type",
    "qual_intercept", "qual_slope", "n_low_qual_bases", "avg_low_qual_base_score", "mate_alignment_score", "alignment_scores_diff",
]


def training_rows(feats: DataFrame, features: list[str], label: str = "class_code", row_id: str = "feat_id") -> DataFrame:
    """``row_id``, ``label`` (0 or 1) and the features as doubles, null and NaN as 0. Rows of no or another class are left out.

    The label is chosen by name; a table without it is an error, whatever its last column is.
    """
    if label not in feats.columns:
        raise ValueError(f"no label column {label}")
    number = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)).alias(c) for c in features]
    return feats.where(F.col(label).isin(0, 1)).select(row_id, F.col(label).cast("int").alias("label"), *number)


def split(rows: DataFrame, row_id: str = "feat_id", train_share: float = 0.2, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    both = stratified_split(rows, "label", row_id, train_share, seed)
    return both.where("is_train").drop("is_train"), both.where("NOT is_train").drop("is_train")


def scaler(features: list[str]) -> Pipeline:
    """Features in one vector, scaled to 0..1 by the training rows' bounds; prediction reuses them."""
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="raw"), MinMaxScaler(inputCol="raw", outputCol="features")])


def scaled(model: PipelineModel, rows: DataFrame, row_id: str = "feat_id") -> DataFrame:
    keep = [c for c in (row_id, "label") if c in rows.columns]
    return model.transform(rows).select(*keep, "features")


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``weight`` n / (2 n_c) of each row; two numbers are sent to all tasks."""
    n = rows.agg(F.count(F.lit(1)).alias("_n"), F.sum("label").alias("_n1"))
    w = F.col("_n") / (2.0 * F.when(F.col("label") == 1, F.col("_n1")).otherwise(F.col("_n") - F.col("_n1")))
    return rows.crossJoin(F.broadcast(n)).withColumn("weight", w).drop("_n", "_n1")


def chance(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


def report(model: str, rows: DataFrame, score: str = "score") -> DataFrame:
    """``model``, ``metric`` and ``value``, for rows with ``label`` and a score; the prediction is score > 0.5."""
    rows = rows.select("label", F.col(score).alias("score"), (F.col(score) > 0.5).cast("int").alias("predicted"))
    cells = metrics.confusion(rows)
    one = cells.crossJoin(metrics.rates(cells)).crossJoin(metrics.brier(rows)).crossJoin(metrics.average_precision(rows))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns]))
    return one.select(F.lit(model).alias("model"), pairs.alias("m")).select("model", "m.*")
