"""The under-sampling queries run at the operator's full setting, and the second stage follows the ensemble."""

import numpy as np
from pyspark.ml.linalg import Vectors

from quillmap.ml import undersample
from quillmap.plans import model_queries


def test_full_setting(monkeypatch):
    """300 subsets at most and the whole grid, for either query; the second stage takes the ensemble's model."""
    calls = []
    monkeypatch.setattr(model_queries, "_data", lambda *a: ("train", "test"))
    monkeypatch.setattr(undersample, "iterative", lambda *a, **kw: calls.append(("iterative", a, kw)) or "first")
    monkeypatch.setattr(undersample, "second_stage", lambda rows, first, *a, **kw: calls.append(("second", first, kw)))
    monkeypatch.setattr(undersample, "decision", lambda model, rows: model)
    monkeypatch.setattr(model_queries, "_logistic", lambda rows: rows)
    monkeypatch.setattr(model_queries.dataset, "report", lambda *a: a)
    model_queries.train_undersample(None, "")
    model_queries.train_second_stage(None, "")
    assert calls == [("iterative", ("train", "lr"), {}), ("iterative", ("train", "lr"), {}), ("second", "first", {})]
    assert undersample.iterative.__name__ == "<lambda>" and undersample.GRID_C == (1.0, 10.0, 100.0, 1000.0)


def test_second_stage(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] + rng.normal(scale=0.7, size=400) > 0).astype(int)
    df = spark.createDataFrame([(i, int(b), Vectors.dense([float(v) for v in a])) for i, (a, b) in enumerate(zip(x, y))], ["feat_id", "label", "features"]).persist()
    first = undersample.estimator("lr", 10.0, 400).fit(df)
    lift = lambda rows: undersample.fourier_features(rows, 2, 32)
    model = undersample.second_stage(df, first, lift, grid=(1.0, 100.0))
    assert model.numFeatures == 32 and undersample.decision(model, lift(df)).count() == 400
    never = df.where("label = 1")
    assert undersample.second_stage(never, first, lift) is None
