"""Training on under-sampled data: the iterative ensemble, its second stage, and balanced bagging."""

from __future__ import annotations

from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators import metrics
from quillmap.operators.sampling import draw, rank_within, resampled_pools, undersampled
from quillmap.session import cut

#: Strengths of regularisation that are searched, as C of the usual notation.
GRID_C = (1.0, 10.0, 100.0, 1000.0)


def estimator(kind: str, c: float, n: int):
    """``lr`` or ``svm`` with the penalty 1 / (C n), the same objective as with a summed loss and C."""
    if kind == "lr":
        return LogisticRegression(regParam=1.0 / (c * n), maxIter=25)
    if kind == "svm":
        return LinearSVC(regParam=1.0 / (c * n), maxIter=30)
    raise ValueError(f"unknown model {kind}")


def searched(kind: str, rows: DataFrame, grid: tuple[float, ...] = GRID_C, folds: int = 2, row_id: str = "feat_id", seed: int = 1):
    """The model with the best weighted F1 in stratified cross-validation, fitted again on all rows."""
    ranked = rank_within(rows.select(row_id, "label"), ["label"], row_id, seed).select(row_id, (F.col("number") % folds).cast("int").alias("fold"))
    spread = rows.join(ranked, row_id).persist()
    n = spread.count()
    # iterations over few rows cost as many tasks as there are partitions
    data = spread.coalesce(n // 100_000 + 1).persist()
    try:
        est = estimator(kind, 1.0, n)
        params = ParamGridBuilder().addGrid(est.regParam, [1.0 / (c * n) for c in grid]).build()
        search = CrossValidator(estimator=est, estimatorParamMaps=params, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, foldCol="fold", parallelism=4)
        return search.fit(data).bestModel
    finally:
        data.unpersist()
        spread.unpersist()


def decision(model, rows: DataFrame) -> DataFrame:
    """``rows`` with ``decision``, the signed distance, and ``predicted``."""
    out = model.transform(rows)
    return out.withColumn("decision", vector_to_array("rawPrediction")[1]).withColumn("predicted", F.col("prediction").cast("int")).drop("rawPrediction", "prediction", "probability")


def iterative(rows: DataFrame, kind: str = "lr", most_subsets: int = 300, grid: tuple[float, ...] = GRID_C, row_id: str = "feat_id", seed: int = 1):
    """The best of models trained on all of the smaller class and equally many of the larger.

    After each model, rows of the larger class in its own subset that it gets right leave the pool; it ends when the pool is smaller than the
    smaller class or after ``most_subsets``. Best is the highest F1 of class 1 on all rows, the first among equals.
    """
    counts = {r["label"]: r["n"] for r in metrics.class_counts(rows).collect()}
    if len(counts) < 2:
        raise ValueError("both classes are needed")
    small = min(counts, key=lambda c: (counts[c], -c))
    least = rows.where(F.col("label") == small)
    pool = rows.where(F.col("label") != small)
    best, best_f1 = None, -1.0
    for step in range(most_subsets):
        subset = cut(undersampled(least.unionByName(pool), "label", row_id, seed=seed + step))
        model = searched(kind, subset, grid, row_id=row_id, seed=seed)
        told = decision(model, rows)
        f1 = metrics.rates(metrics.confusion(told)).first()["f1_1"] or 0.0
        if f1 > best_f1:
            best, best_f1 = model, f1
        pool = shrunk(pool, subset, model, small, row_id)
        if pool.count() < counts[small]:
            break
    return best


def shrunk(pool: DataFrame, subset: DataFrame, model, small: int, row_id: str = "feat_id") -> DataFrame:
    """``pool`` without the rows of the larger class in ``subset`` that ``model`` gets right: at most as many as the smaller class has rows."""
    right = decision(model, subset).where((F.col("label") != small) & (F.col("predicted") == F.col("label"))).select(row_id)
    # the pool is cut each time: a chain of anti joins would be planned and run from the start again
    return cut(pool.join(right, row_id, "left_anti"))


def fourier_features(rows: DataFrame, dims: int, size: int = 128, gamma: float = 1.0, seed: int = 1) -> DataFrame:
    """Random Fourier features of a Gaussian kernel in place of ``features``: a linear model on them approximates a kernel machine."""
    import numpy as np

    rng = np.random.default_rng(seed)
    w = rng.normal(scale=(2 * gamma) ** 0.5, size=(dims, size))
    b = rng.uniform(0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def lift(x):
        import pandas as pd

        z = np.sqrt(2.0 / size) * np.cos(np.stack(x.to_numpy()) @ w + b) if len(x) else np.zeros((0, size))
        return pd.Series(list(z))

    return rows.withColumn("features", array_to_vector(lift(vector_to_array("features"))))


def second_stage(rows: DataFrame, first, lift=lambda rows: rows, grid: tuple[float, ...] = GRID_C, row_id: str = "feat_id", factor: int = 2, seed: int = 1):
    """A kernel machine with a searched penalty, trained on draws from the first model's FN, TN, FP and TP.

    ``lift`` turns the first model's features into those of the machine, such as ``fourier_features``. Rows drawn more than
    once count as often; where the draws hold one class only, or too few rows of either for two folds, there is none (None).
    """
    told = decision(first, rows)
    draws = resampled_pools(told, "label", "predicted", row_id, factor, seed).select(F.col(row_id).alias("_of"))
    drawn = draws.join(lift(rows).withColumnRenamed(row_id, "_of"), "_of")
    # copies get keys of their own, so that folds are drawn among copies
    drawn = cut(drawn.withColumn(row_id, F.monotonically_increasing_id()).drop("_of"))
    counts = {r["label"]: r["n"] for r in metrics.class_counts(drawn).collect()}
    if len(counts) < 2 or min(counts.values()) < 2:
        return None
    return searched("svm", drawn, grid, row_id=row_id, seed=seed)


def balanced_bagging(rows: DataFrame, bags: int = 1, c: float = 100.0, row_id: str = "feat_id", seed: int = 1) -> tuple[list, DataFrame]:
    """Linear machines on bootstrap samples that are then balanced, and the out-of-bag decisions (mean over the bags a row is not in).

    A bootstrap gives each row a Poisson number of copies from its key; a row is out of the bag where that is 0.
    """
    models, out = [], None
    for bag in range(bags):
        u = draw(F.col(row_id), seed * 104729 + bag) / F.lit(float(1 << 32))
        # Poisson(1): 0, 1, 2, 3 or 4 copies
        copies = F.when(u < 0.3679, 0).when(u < 0.7358, 1).when(u < 0.9197, 2).when(u < 0.981, 3).otherwise(4)
        bagged = rows.withColumn("weight", copies.cast("double"))
        inside = undersampled(bagged.where("weight > 0"), "label", row_id, seed=seed + bag)
        model = LinearSVC(regParam=1.0 / (c * max(1, inside.count())), maxIter=30, weightCol="weight").fit(inside)
        models.append(model)
        told = decision(model, bagged.where("weight = 0")).select(row_id, "label", "decision")
        out = told if out is None else out.unionByName(told)
    return models, out.groupBy(row_id, "label").agg(F.avg("decision").alias("decision"))
