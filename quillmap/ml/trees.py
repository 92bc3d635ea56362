"""Boosted trees with a randomised search of their settings."""

from __future__ import annotations

import random
from itertools import product

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values that settings are drawn from.
CHOICES = {"maxIter": (20, 40, 80), "maxDepth": (3, 4, 5, 6), "stepSize": (0.05, 0.1, 0.2, 0.3), "subsamplingRate": (0.6, 0.8, 1.0), "minInstancesPerNode": (1, 5, 20)}


def drawn_settings(tries: int, seed: int = 1, choices: dict[str, tuple] = CHOICES) -> list[dict]:
    """``tries`` different settings (all, if there are fewer) drawn evenly from all combinations."""
    every = [dict(zip(choices, x)) for x in product(*choices.values())]
    return random.Random(seed).sample(every, min(tries, len(every)))


def searched_trees(rows: DataFrame, tries: int = 6, folds: int = 2, seed: int = 1, row_id: str = "feat_id", choices: dict[str, tuple] = CHOICES) -> tuple[GBTClassificationModel, dict]:
    """The boosted trees of the drawn setting with the best area under precision and recall in cross-validation, and that setting.

    Folds follow the hash of ``row_id``, so they are the same for every setting and run; settings run side by side. Rows are
    weighted by ``weight``. The model is fitted again on all rows. A fold without rows of either class counts for as much as Spark's evaluator says.
    """
    trees = GBTClassifier(weightCol="weight", seed=seed)
    settings = drawn_settings(tries, seed, choices)
    grid = [{trees.getParam(k): v for k, v in own.items()} for own in settings]
    folded = rows.withColumn("fold", F.pmod(F.xxhash64(row_id, F.lit(seed)), F.lit(folds)).cast("int"))
    search = CrossValidator(
        estimator=trees, estimatorParamMaps=grid, evaluator=BinaryClassificationEvaluator(metricName="areaUnderPR", weightCol="weight"), numFolds=folds, foldCol="fold", parallelism=4
    )
    fitted = search.fit(folded)
    best = max(range(len(grid)), key=lambda i: (fitted.avgMetrics[i], -i))
    return fitted.bestModel, settings[best]
