"""Training and prediction over the whole feature table: each query reports a model's metrics on the rows it wasn't trained on."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.sql import functions as F

from quillmap.functions import reads as R
from quillmap.ml import boost, calibrate, dataset, neighbors, trees, undersample
from quillmap.ml.dataset import DEFAULT_FEATURES
from quillmap.operators import metrics
from quillmap.session import stored
from quillmap.sources.tables import table


def _data(spark, d, features=DEFAULT_FEATURES):
    train, test = dataset.split(dataset.training_rows(table(spark, d, "feats"), features))
    scale = dataset.scaler(features).fit(train)
    # read many times, by jobs that outlive this call: kept as a table, not in memory
    return stored(dataset.scaled(scale, train)), dataset.scaled(scale, test)


def _logistic(rows):
    return rows.withColumn("score", 1 / (1 + F.exp(-F.col("decision"))))


def train_lr(spark, d):
    train, test = _data(spark, d)
    model = LogisticRegression(weightCol="weight", maxIter=50).fit(dataset.balanced_weights(train))
    return dataset.report("lr", model.transform(test).withColumn("score", dataset.chance()))


def train_undersample(spark, d):
    train, test = _data(spark, d)
    model = undersample.iterative(train, "lr")
    return dataset.report("rulr", _logistic(undersample.decision(model, test)))


def train_second_stage(spark, d):
    """The under-sampling ensemble, then a kernel machine on draws from its right and wrong rows; without wrong ones, the ensemble's model."""
    train, test = _data(spark, d)
    lift = lambda rows: undersample.fourier_features(rows, len(DEFAULT_FEATURES))
    first = undersample.iterative(train, "lr")
    model = undersample.second_stage(train, first, lift)
    told = undersample.decision(first, test) if model is None else undersample.decision(model, lift(test))
    return dataset.report("rulrs", _logistic(told))


def train_adaboost(spark, d):
    train, test = _data(spark, d)
    return dataset.report("adb", boost.searched(train).scored(test))


def train_rusboost(spark, d):
    train, test = _data(spark, d)
    return dataset.report("rubst", boost.searched(train, undersample=True).scored(test))


def train_easy_ensemble(spark, d):
    train, test = _data(spark, d)
    return dataset.report("easy", boost.easy_ensemble(train, bags=4, rounds=10).scored(test))


def train_bagging(spark, d):
    train, test = _data(spark, d)
    models, _ = undersample.balanced_bagging(train)
    return dataset.report("dtbg", _logistic(undersample.decision(models[0], test)))


def train_gbt(spark, d):
    train, test = _data(spark, d)
    model = GBTClassifier(weightCol="weight", maxIter=30, maxDepth=4, seed=1).fit(dataset.balanced_weights(train))
    return dataset.report("gbt", model.transform(test).withColumn("score", dataset.chance()))


def train_gbt_searched(spark, d):
    """Boosted trees whose settings come from a randomised search."""
    train, test = _data(spark, d)
    model, _ = trees.searched_trees(dataset.balanced_weights(train))
    return dataset.report("gbt_searched", model.transform(test).withColumn("score", dataset.chance()))


def train_gbt_stopped(spark, d):
    """Boosted trees that stop once a tenth of the training rows, held back, no longer improves."""
    train, test = _data(spark, d)
    rows = dataset.balanced_weights(train).withColumn("held", F.pmod(F.xxhash64("feat_id"), F.lit(10)) == 0)
    model = GBTClassifier(weightCol="weight", validationIndicatorCol="held", maxIter=60, maxDepth=3, seed=1).fit(rows)
    return dataset.report("gbt_stopped", model.transform(test).withColumn("score", dataset.chance()))


def predicted_scores(spark, d):
    """The whole path to new scores: train, calibrate on the training rows, predict the others, and turn chances into phred."""
    train, test = _data(spark, d)
    model = LogisticRegression(maxIter=50).fit(train)
    chance = lambda rows: model.transform(rows).select("feat_id", "label", dataset.chance().alias("score"))
    curve = calibrate.fit_isotonic(chance(train), "label", "score")
    told = calibrate.apply_isotonic(chance(test), curve, "score")
    return told.select("feat_id", R.phred(F.col("probability")).alias("mapq_new"), (F.col("probability") > 0.5).cast("int").alias("predicted"))


NEAR = DEFAULT_FEATURES
#: Scaled features are rounded to this grid, so that sums of squares are exact and equal distances are equal in any order of summing.
GRID = 1 << 16


def _near(spark, d):
    """All labelled rows with their features scaled to 0..1 over the table."""
    rows = dataset.training_rows(table(spark, d, "feats"), NEAR)
    rows = metrics.minmax_scaled(rows, NEAR, ("feat_id", "label"))
    return stored(rows.select("feat_id", "label", *[(F.round(F.col(c) * GRID) / GRID).alias(c) for c in NEAR]))


def knn(spark, d):
    """Queries: every row whose id is divisible by 20, against all rows."""
    return neighbors.knn_scores(_near(spark, d), NEAR, "label", "feat_id", 5, wanted=F.col("feat_id") % 20 == 0).select(F.col("query").alias("feat_id"), "score")


def tomek(spark, d):
    return neighbors.tomek_links(_near(spark, d), NEAR, "label", "feat_id")


def rerank_positives(spark, d):
    """New scores of the rows that a first model takes for misaligned, from a second one trained on them without Tomek links."""
    train, test = _data(spark, d)
    model = LogisticRegression(weightCol="weight", maxIter=50).fit(dataset.balanced_weights(train))
    told = model.transform(test).withColumn("score", dataset.chance()).select("feat_id", "label", "features", "score")
    return neighbors.reranked(told, len(DEFAULT_FEATURES))


def svm_calibrated(spark, d):
    """Chances from a linear machine: its decision values through an isotonic map fitted on the training rows."""
    train, test = _data(spark, d)
    model = undersample.estimator("svm", 100.0, train.count()).fit(train)
    curve = calibrate.fit_isotonic(undersample.decision(model, train), "label", "decision")
    told = calibrate.apply_isotonic(undersample.decision(model, test), curve, "decision")
    return told.select("feat_id", "label", F.col("probability").alias("score"))


_CLEAN = ", ".join(f"coalesce(CASE WHEN NOT isnan({c}) THEN {c} END, 0) AS {c}" for c in NEAR)
_SCALED = ", ".join(f"coalesce(round(({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) * {GRID}) / {GRID}, 0)" for c in NEAR)
_V = f"""c AS (SELECT feat_id, CAST(class_code AS INTEGER) AS label, {_CLEAN} FROM feats WHERE class_code IN (0, 1)), v AS (SELECT feat_id, label, [{_SCALED}] AS x FROM c)"""

QUERIES = {
    "train_lr": (train_lr, None),
    "train_undersample": (train_undersample, None),
    "train_second_stage": (train_second_stage, None),
    "train_adaboost": (train_adaboost, None),
    "train_rusboost": (train_rusboost, None),
    "train_easy_ensemble": (train_easy_ensemble, None),
    "train_bagging": (train_bagging, None),
    "train_gbt": (train_gbt, None),
    "train_gbt_searched": (train_gbt_searched, None),
    "train_gbt_stopped": (train_gbt_stopped, None),
    "predicted_scores": (predicted_scores, None),
    "rerank_positives": (rerank_positives, None),
    "svm_calibrated": (lambda s, d: dataset.report("svm", svm_calibrated(s, d)), None),
    "knn": (
        knn,
        f"""WITH {_V}, d AS (SELECT q.feat_id, v.feat_id AS b, v.label, list_distance(q.x, v.x) AS far FROM v q JOIN v ON q.feat_id <> v.feat_id WHERE q.feat_id % 20 = 0),
        r AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY feat_id ORDER BY far, b) <= 5) SELECT feat_id, avg(label) AS score FROM r GROUP BY feat_id""",
    ),
    "tomek_links": (
        tomek,
        f"""WITH {_V}, n AS (SELECT q.feat_id AS a, q.label, arg_min(v.feat_id, (list_distance(q.x, v.x), v.feat_id)) AS b FROM v q JOIN v ON q.feat_id <> v.feat_id GROUP BY ALL)
        SELECT x.a, x.b FROM n x JOIN n y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b AND x.label <> y.label""",
    ),
}
