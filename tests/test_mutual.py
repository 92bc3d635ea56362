"""Mutual nearest rows of different classes: against brute force, over ties and dirt, and what they send."""

import numpy as np
import pytest

from quillmap.ml import neighbors
from quillmap.operators import mutual


def brute(ids, x, y):
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    d[ids[:, None] == ids[None]] = np.inf
    best = [min((v, i) for v, i in zip(r, ids))[1] for r in d]
    of, label = dict(zip(ids, best)), dict(zip(ids, y))
    return sorted((int(a), int(b)) for a, b in of.items() if a < b and of[b] == a and label[a] != label[b])


@pytest.fixture
def small(monkeypatch):
    for name, value in (("CELL_ROWS", 60), ("LEAST_SAMPLED", 8), ("TASK_ROWS", 50), ("LEAF_ROWS", 16), ("PACK_ROWS", 90), ("BLOCK", 40), ("PRODUCTS", 300)):
        monkeypatch.setattr(mutual, name, value)


@pytest.mark.parametrize("classes", [2, 3])
def test_pairs_are_exact(spark, small, classes):
    rng = np.random.default_rng(classes)
    # two coordinates of few values, and a third of all rows one point
    x = np.column_stack([rng.integers(0, 2, 900), rng.integers(0, 12, 900) / 4, rng.integers(0, 40, 900) / 8]).astype(float)
    x[:300] = x[0]
    x[600:] += rng.integers(-4000, 4000, (300, 3)) / 1024
    y, ids = rng.choice(classes, 900, p=[0.8, 0.2] if classes == 2 else [0.6, 0.2, 0.2]), rng.permutation(9000)[:900]
    df = spark.createDataFrame([(int(i), int(c), *map(float, v)) for i, c, v in zip(ids, y, x)], "i bigint, y int, a double, b double, c double")
    want = brute(ids, x, y)
    got = neighbors.tomek_links(df.repartition(5), ["a", "b", "c"], "y", "i").collect()
    assert sorted(map(tuple, got)) == want and len(want) > 10


def test_dirt(spark):
    nan = float("nan")
    rows = [(1, 0, 0.0, None), (2, 1, 0.0, nan), (3, 0, 5.0, 1.0), (4, None, 5.0, 1.0), (None, 1, 5.0, 1.0), (5, 1, 7.0, 1.0)]
    df = spark.createDataFrame(rows, "i bigint, y int, a double, b double")
    links = lambda t: sorted(map(tuple, neighbors.tomek_links(t, ["a", "b"], "y", "i").collect()))
    assert links(df) == [(1, 2), (3, 5)]
    assert links(df.limit(0)) == links(df.where("y = 0")) == links(df.where("i = 1")) == links(df.where("y IS NULL")) == []
    # all rows are one point: each finds the lowest other id
    same = spark.createDataFrame([(i, int(i % 3 == 0), 1.0, 1.0) for i in range(1, 400)], "i bigint, y int, a double, b double")
    assert links(same) == [] and links(same.where("i > 1")) == [(2, 3)]


def sent(spark) -> int:
    """Bytes that the last stages wrote for others to read."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def test_each_round_sends_the_rows_once(spark):
    # 50,000 rows of 15 values around a plane: a copy of the rows in blocks for each of three rounds, and a few rows for each query
    df = spark.range(50_000).selectExpr("id AS i", "int(xxhash64(id) % 10 = 0) AS y", *[f"pmod(xxhash64(id, {j % 2}), 4096) / 4096 + pmod(xxhash64(id, {j}, 7), 64) / 4096 AS f{j}" for j in range(15)])
    before = sent(spark)
    assert neighbors.tomek_links(df, [f"f{j}" for j in range(15)], "y", "i").count() > 0
    assert sent(spark) - before < 10e6
