"""Similar vectors: recall against brute force, own reads left out, dirt."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import neighbors
from quillmap.operators import nearest


def test_chi_square():
    assert abs(neighbors.chi_square(15.507, 8) - 0.95) < 1e-4
    assert abs(neighbors.chi_square_point(0.99, 8) - 20.09) < 0.01


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(60, 6)) * 3
    x = (centres[rng.integers(0, 60, 3000)] + rng.normal(size=(3000, 6)) * 0.4).round(4)
    x[:400] = x[5]
    rows = [(i, f"chr1-1-C:chr1-2-D::{i // 2}/1" if i % 50 else None, *map(float, v), "clash", 3) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "feat_id bigint, read_name string, a double, b double, c double, d double, e double, f double, cell string, query int")
    scale = spark.createDataFrame([(n, 0.5, 2.0, 0.0) for n in "abcdef"] + [("g", 0.0, 0.0, 0.0), (None, 0.0, 1.0, 0.0)], "feature string, centre double, spread double, fallback double")
    return df, scale, x


def test_recall(spark, table, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 200)
    monkeypatch.setattr(nearest, "TASK_ROWS", 150)
    df, scale, x = table
    got: dict[int, list[int]] = {}
    for r in neighbors.similar_rows(df, scale, wanted=F.col("feat_id") % 20 == 0).collect():
        got.setdefault(r["query"], []).append(r["id"])
    v = ((x - 0.5) / 2).astype(np.float32).astype(float)
    hit = total = 0
    for q in range(0, 3000, 20):
        d = ((v - v[q]) ** 2).sum(1)
        own = {q} if q % 50 == 0 else {q} | ({q + 1} if (q + 1) % 50 and (q + 1) // 2 == q // 2 else set())
        want = [i for _, i in sorted((d[i], i) for i in range(3000) if i not in own)[:5]]
        assert not own & set(got[q]) and len(got[q]) == 5
        hit, total = hit + len(set(want) & set(got[q])), total + 5
    assert hit / total >= 0.95


def test_dirt(spark, table):
    df, scale, _ = table
    small = df.limit(40).withColumn("a", F.when(F.col("feat_id") == 3, None).when(F.col("feat_id") == 4, float("nan")).otherwise(F.col("a")))
    probe = spark.createDataFrame([(3,), (3,), (None,), (999_999,)], "feat_id bigint")
    got = neighbors.similar_rows(small, scale, probe).collect()
    assert {r["query"] for r in got} == {3} and len(got) == 5 and all(r["distance"] == r["distance"] for r in got)
    assert neighbors.similar_rows(small.limit(0), scale).count() == 0
    assert neighbors.similar_rows(small, scale, probe.limit(0)).count() == 0
    assert neighbors.similar_rows(small.where("feat_id IN (1, 2)"), scale).count() == 2
    assert neighbors.similar_rows(small, scale.limit(0)).collect() == []
    nameless = small.withColumn("feat_id", F.when(F.col("feat_id") % 2 == 1, F.col("feat_id")))
    got = neighbors.similar_rows(nameless, scale).collect()
    assert {r["query"] % 2 for r in got} == {r["id"] % 2 for r in got} == {1}
