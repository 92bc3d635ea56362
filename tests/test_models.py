"""Trainers: held-out quality on separable data, and properties that must hold."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from quillmap.ml import boost, calibrate, dataset, neighbors, store, trees, undersample


@pytest.fixture(scope="module")
def rings(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (1200, 2))
    y = ((np.abs(x - 0.5) < 0.3).all(1)).astype(int)
    return spark.createDataFrame([(i, int(b), Vectors.dense([float(v) for v in a])) for i, (a, b) in enumerate(zip(x, y))], ["feat_id", "label", "features"]).persist()


def f1(rows):
    return rows.select(F.col("label") == (F.col("score") > 0.5).cast("int")).toPandas().mean().iloc[0]


@pytest.mark.parametrize("kw", [{}, {"real": False}, {"undersample": True}])
def test_boosting(rings, kw):
    model = boost.adaboost(rings, rounds=12, **kw)
    assert 1 <= len(model.stumps) <= 12
    assert f1(model.scored(rings)) > 0.8


def test_store(spark, rings, tmp_path):
    model = boost.adaboost(rings, rounds=3)
    store.save_boosted(spark, model, str(tmp_path / "m"))
    assert store.load_boosted(spark, str(tmp_path / "m")) == model
    curve = calibrate.fit_isotonic(model.scored(rings), "label", "score")
    store.save_model(curve, str(tmp_path / "i"))
    assert store.load_isotonic(str(tmp_path / "i")).boundaries == curve.boundaries


def test_boosting_one_class(rings):
    only = rings.where("label = 0")
    assert boost.adaboost(only, 3).scored(only).where("score > 0.5").count() == 0


def test_easy_ensemble(rings):
    assert f1(boost.easy_ensemble(rings, bags=2, rounds=6).scored(rings)) > 0.75
    only = rings.where("label = 1")
    assert boost.easy_ensemble(only).stumps == [] == boost.easy_ensemble(only.limit(0)).stumps
    assert boost.easy_ensemble(only).scored(only).count() == only.count()


def test_searched_trees(rings):
    drawn = trees.drawn_settings(30, seed=4)
    assert len({tuple(x.values()) for x in drawn}) == 30 and drawn == trees.drawn_settings(30, seed=4)
    choices = {"maxIter": (1, 8), "maxDepth": (1, 4)}
    assert len(trees.drawn_settings(99, choices=choices)) == 4
    model, setting = trees.searched_trees(dataset.balanced_weights(rings), tries=4, choices=choices)
    # stumps can't tell a square from its surroundings
    assert setting["maxDepth"] == 4 and model.getNumTrees == setting["maxIter"]
    assert f1(model.transform(rings).withColumn("score", dataset.chance())) > 0.95


def test_iterative_and_bagging(spark):
    rng = np.random.default_rng(3)
    rows = [(i, int(i % 5 == 0), Vectors.dense([float(rng.normal(2.0 * (i % 5 == 0))), float(rng.normal())])) for i in range(600)]
    df = spark.createDataFrame(rows, ["feat_id", "label", "features"]).persist()
    model = undersample.iterative(df, "lr", most_subsets=2, grid=(1.0, 100.0))
    told = undersample.decision(model, df)
    assert told.where("label = predicted").count() > 450
    models, out = undersample.balanced_bagging(df, bags=2)
    assert len(models) == 2 and 200 < out.count() < 600
    with pytest.raises(ValueError):
        undersample.iterative(df.where("label = 0"))


def test_kernel_features(rings):
    lifted = undersample.fourier_features(rings, 2, 200, gamma=8.0)
    model = undersample.LinearSVC(regParam=1e-3, maxIter=30).fit(lifted)
    assert undersample.decision(model, lifted).where("label = predicted").count() > 0.85 * 1200


def test_isotonic(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 1), (2.0, 0), (3.0, 0), (4.0, 1), (None, 1)], "x double, y int")
    model = calibrate.fit_isotonic(df, "y", "x")
    got = calibrate.apply_isotonic(spark.createDataFrame([(0.0,), (1.0,), (2.0,), (3.0,), (4.0,), (9.0,)], "s double"), model, "s")
    assert np.allclose([r["probability"] for r in got.orderBy("s").collect()], [0, 0, 1 / 3, 1 / 3, 1, 1])


def test_label_by_name(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, None, float("nan")), (3, float("nan"), 0.0), (4, 1.0, 2.0)], "feat_id bigint, mapq double, class_code double")
    got = dataset.training_rows(df, ["mapq"]).orderBy("feat_id").collect()
    assert [tuple(r) for r in got] == [(1, 1, 2.0), (3, 0, 0.0)]
    with pytest.raises(ValueError):
        dataset.training_rows(df.drop("class_code"), ["mapq"])


def test_neighbours(spark):
    df = spark.createDataFrame([(i, float(x), y) for i, (x, y) in enumerate([(0, 0), (1, 0), (2, 0), (2.5, 1), (9, 1), (10, 1), (30, None)])], "i bigint, x double, y int")
    assert [tuple(r) for r in neighbors.tomek_links(df, ["x"], "y", "i").collect()] == [(2, 3)]
    assert {r["i"] for r in neighbors.without_tomek_links(df, ["x"], "y", "i").collect()} == {0, 1, 3, 4, 5, 6}
    got = {r["query"]: r["score"] for r in neighbors.knn_scores(df, ["x"], "y", "i", 2).collect()}
    assert got[0] == 0 and got[5] == 1 and got[2] == 0.5
    by = {r["query"]: r["score"] for r in neighbors.knn_scores(df, ["x"], "y", "i", 2, by_distance=True).collect()}
    assert np.isclose(by[2], (1 / 0.5) / (1 / 0.5 + 1))


def test_searched_boosting(rings):
    model = boost.searched(rings, rates=(0.5, 1.0), rounds=(2, 12), folds=2)
    assert len(model.stumps) == 12 and f1(model.scored(rings)) > 0.8
    # a shorter fit is the beginning of a longer one
    assert boost.adaboost(rings, 3).stumps == boost.adaboost(rings, 5).stumps[:3]


def test_the_pool_loses_rows_of_the_subset_alone(spark):
    rng = np.random.default_rng(4)
    rows = [(i, int(i < 40), Vectors.dense([float(rng.normal(3.0 * (i < 40)))])) for i in range(600)]
    df = spark.createDataFrame(rows, ["feat_id", "label", "features"]).persist()
    pool = df.where("label = 0")
    for step in range(3):
        subset = undersample.undersampled(df.where("label = 1").unionByName(pool), "label", "feat_id", seed=step).persist()
        model = undersample.estimator("lr", 10.0, 80).fit(subset)
        left = undersample.shrunk(pool, subset, model, 1)
        lost = {r["feat_id"] for r in pool.collect()} - {r["feat_id"] for r in left.collect()}
        assert 20 < len(lost) <= 40 and lost <= {r["feat_id"] for r in subset.where("label = 0").collect()}
        pool = left


def test_reranked(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(400):
        y = int(rng.random() < 0.5)
        x = rng.normal(size=2) + (2.0 * y, 0.0)
        rows.append((i, y, Vectors.dense([float(v) for v in x]), 0.9 if i % 4 else 0.1))
    df = spark.createDataFrame(rows, ["feat_id", "label", "features", "score"])
    got = {r["feat_id"]: r["score"] for r in neighbors.reranked(df, 2).collect()}
    assert len(got) == 300
    assert sum((got[i] > 0.5) == (rows[i][1] == 1) for i in got) > 230
    one = neighbors.reranked(df.where("label = 1"), 2).collect()
    assert one and all(r["score"] == 0.9 for r in one)
