"""k-nearest-neighbour classification and Tomek links, over exact nearest rows and exact mutual ones."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.ml import undersample
from quillmap.operators import metrics
from quillmap.operators.mutual import mutual_pairs
from quillmap.operators.nearest import nearest_rows
from quillmap.session import stored


def knn_scores(rows: DataFrame, features: list[str], label: str, row_id: str, k: int = 5, wanted: Column | None = None, by_distance: bool = False) -> DataFrame:
    """``query`` and ``score``, the share of class 1 among the ``k`` nearest labelled rows, each alike or by the inverse of its distance.

    With ``by_distance``, rows at distance 0 outweigh all others.
    """
    known = rows.where(F.col(label).isNotNull())
    near = nearest_rows(known, features, k, row_id, wanted=wanted)
    votes = near.join(known.select(F.col(row_id).alias("id"), F.col(label).alias("_y")), "id")
    if not by_distance:
        return votes.groupBy("query").agg(F.avg("_y").alias("score"))
    same = F.max((F.col("distance") == 0).cast("int"))
    w = F.sum(F.when(F.col("distance") > 0, 1 / F.col("distance")))
    wy = F.sum(F.when(F.col("distance") > 0, F.col("_y") / F.col("distance")))
    return votes.groupBy("query").agg(F.when(same == 1, F.avg(F.when(F.col("distance") == 0, F.col("_y")))).otherwise(wy / w).alias("score"))


def tomek_links(rows: DataFrame, features: list[str], label: str, row_id: str) -> DataFrame:
    """``a`` < ``b``: rows of different classes that are each other's nearest row."""
    return mutual_pairs(rows, features, label, row_id)


def reranked(rows: DataFrame, dims: int, row_id: str = "feat_id", threshold: float = 0.5, digits: int = 6) -> DataFrame:
    """``row_id`` and ``score`` of the rows whose first ``score`` is above ``threshold``, from a logistic model of their own.

    ``rows`` has ``label`` and ``features``. The model is trained on those rows without the larger class's ends of Tomek links, with balanced
    weights and a searched penalty. Where they hold one class only, the first score stays.
    """
    names = [f"_x{j}" for j in range(dims)]
    x = vector_to_array("features")
    positive = stored(rows.where(F.col("score") > threshold).select(row_id, "label", "features", "score", *[F.round(x[j], digits).alias(n) for j, n in enumerate(names)]))
    counts = {r["label"]: r["n"] for r in metrics.class_counts(positive).collect()}
    if len(counts) < 2 or min(counts.values()) < 4:
        return positive.select(row_id, "score")
    clean = without_tomek_links(positive, names, "label", row_id, max(counts, key=counts.get)).select(row_id, "label", "features")
    kept = {r["label"]: r["n"] for r in metrics.class_counts(clean).collect()}
    if len(kept) < 2 or min(kept.values()) < 4:
        return positive.select(row_id, "score")
    model = undersample.searched("lr", stored(clean), row_id=row_id)
    return model.transform(positive.select(row_id, "features")).select(row_id, vector_to_array("probability")[1].alias("score"))


def without_tomek_links(rows: DataFrame, features: list[str], label: str, row_id: str, majority: int = 0) -> DataFrame:
    """Rows without those of the larger class that are part of a Tomek link."""
    ends = tomek_links(rows, features, label, row_id).select(F.explode(F.array("a", "b")).alias(row_id)).distinct()
    own = rows.where(F.col(label) == majority).select(row_id).join(ends, row_id)
    return rows.join(own, row_id, "left_anti")
