"""Classification metrics over a table with a 0/1 label, a prediction and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import cut


def _ratio(a: Column, b: Column) -> Column:
    return a / F.nullif(b.cast("double"), F.lit(0.0))


def confusion(rows: DataFrame, label: str = "label", predicted: str = "predicted", by: tuple[str, ...] = ()) -> DataFrame:
    """``tn``, ``fp``, ``fn`` and ``tp`` in one pass, for each group of ``by``; rows with a null label or prediction count nowhere."""
    y, p = F.col(label), F.col(predicted)
    cells = {"tn": (0, 0), "fp": (0, 1), "fn": (1, 0), "tp": (1, 1)}
    return rows.groupBy(*by).agg(*[F.count_if((y == a) & (p == b)).alias(n) for n, (a, b) in cells.items()])


def rates(cells: DataFrame) -> DataFrame:
    """Precision, recall and F1 of either class, accuracy, sensitivity, specificity, their geometric mean and the weighted F1."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    n0, n1 = tn + fp, tp + fn
    f1, f0 = _ratio(2 * tp, 2 * tp + fp + fn), _ratio(2 * tn, 2 * tn + fp + fn)
    columns = {
        "precision_1": _ratio(tp, tp + fp),
        "recall_1": _ratio(tp, n1),
        "f1_1": f1,
        "precision_0": _ratio(tn, tn + fn),
        "recall_0": _ratio(tn, n0),
        "f1_0": f0,
        "accuracy": _ratio(tp + tn, n0 + n1),
        "gmean": F.sqrt(_ratio(tp, n1) * _ratio(tn, n0)),
        "gmean_weighted": F.sqrt((_ratio(tp, n1) * n1 + _ratio(tn, n0) * n0) / (n0 + n1) * (_ratio(tn, n0) * n1 + _ratio(tp, n1) * n0) / (n0 + n1)),
        "f1_weighted": _ratio(F.coalesce(f1, F.lit(0.0)) * n1 + F.coalesce(f0, F.lit(0.0)) * n0, n0 + n1),
    }
    return cells.select(*[c for c in cells.columns if c not in ("tn", "fp", "fn", "tp")], *[e.alias(c) for c, e in columns.items()])


def brier(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    return rows.agg(F.avg((F.col(score) - F.col(label)) * (F.col(score) - F.col(label))).alias("brier"))


def average_precision(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Sum over distinct scores, highest first, of the step in recall times precision.

    Rows combine to one for each distinct score. Running counts are taken within ranges of about equally many scores, each starting from the
    sum of the ranges above it, so that no task sees all scores, however they cluster.
    """
    points = rows.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("bigint")).alias("tp")
    )
    # the ranges are drawn by sampling, so what they come out as is written before it is used twice
    points = cut(points.repartitionByRange(F.desc("s")).withColumn("_at", F.spark_partition_id()))
    points = points.crossJoin(F.broadcast(points.agg(F.sum("tp").alias("_all"))))
    sums = points.groupBy("_at").agg(F.sum("n").alias("_n"), F.sum("tp").alias("_tp"))
    above = Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_at", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_n"), F.coalesce(F.sum("_tp").over(above), F.lit(0)).alias("_tp"))
    within = Window.partitionBy("_at").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    run = points.join(F.broadcast(sums), "_at").select("tp", "_all", (F.sum("n").over(within) + F.col("_n")).alias("seen"), (F.sum("tp").over(within) + F.col("_tp")).alias("hits"))
    return run.agg(F.sum(F.col("tp") / F.nullif(F.col("_all"), F.lit(0)) * F.col("hits") / F.col("seen")).alias("average_precision"))


def _bin(score: str, bins: int) -> Column:
    return F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int")


def calibration_curve(rows: DataFrame, label: str = "label", score: str = "score", bins: int = 10) -> DataFrame:
    """Mean score and share of positives in equal bins of 0..1; empty bins are left out."""
    fine = rows.where(F.col(label).isNotNull() & F.col(score).between(0, 1))
    return fine.groupBy(_bin(score, bins).alias("bin")).agg(F.avg(score).alias("mean_score"), F.avg(label).alias("positives"), F.count(F.lit(1)).alias("n"))


def score_histogram(rows: DataFrame, score: str = "score", bins: int = 10) -> DataFrame:
    return rows.where(F.col(score).between(0, 1)).groupBy(_bin(score, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def class_counts(rows: DataFrame, label: str = "label") -> DataFrame:
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def minmax_scaled(rows: DataFrame, columns: list[str], keep: tuple[str, ...]) -> DataFrame:
    """(value - least) / (greatest - least); a constant column gives 0, null and NaN give null. One pass for the bounds."""
    clean = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    ends = rows.agg(*[f(clean[c]).alias(f"_{n}_{c}") for c in columns for n, f in (("low", F.min), ("high", F.max))])
    scaled = [
        F.when(F.col(f"_high_{c}") > F.col(f"_low_{c}"), (clean[c] - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}"))).when(clean[c].isNotNull(), 0.0).alias(c) for c in columns
    ]
    return rows.crossJoin(F.broadcast(ends)).select(*keep, *scaled)
