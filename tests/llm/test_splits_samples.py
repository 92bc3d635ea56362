"""Splits, fixed-size samples and quota samples, with dirt of every kind."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.llm import fixed_sample, quota_sample, splits

FEATS = "feat_id bigint, read_name string, run_id string, class_code double, mapq double, arrived_at int, component string, n bigint"


def feats(spark, rows):
    """Rows of (id, name[, class, arrival, run]); two more columns carry names that operators use themselves."""
    full = [(r[0], r[1], r[4] if len(r) > 4 else "R1", r[2] if len(r) > 2 else 0.0, 1.0, r[3] if len(r) > 3 else 0, "clash", 9) for r in rows]
    return spark.createDataFrame(full, FEATS)


def alias(spark, pairs):
    return spark.createDataFrame([(*p, "x") for p in pairs], "name_a string, name_b string, component string")


def t(i, mate="/1"):
    return f"chr1-{i}-C:chr1-{i}-D::{i}{mate}"


def test_hash_to_min_against_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randint(0, 150)}", f"n{rng.randint(0, 150)}") for _ in range(110)] + [(f"p{i}", f"p{i + 1}") for i in range(60)] + [("hub", f"s{i}") for i in range(80)]
    edges += [(None, "n1"), ("n1", None), ("solo", "solo")] + edges[:10]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in splits.hash_to_min(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in list(parent)}


def test_related_groups(spark):
    rows = feats(spark, [(1, t(1)), (2, t(1, "_2")), (3, t(2).upper() + " "), (4, t(5)), (5, t(7)), (6, None), (7, " "), (8, t(5, " 2:N:0")), (9, t(8)), (10, t(8))])
    ties = alias(spark, [(t(1, ""), " " + t(900, "").upper()), (t(900, ""), t(2, "")), (t(5, ""), None), (t(7, ""), t(7, "")), (t(8, ""), t(901, "")), (None, None)])
    got = sorted(map(tuple, splits.related_groups(rows, ties).collect()))
    assert got == [(1, 1), (1, 2), (1, 3)]
    assert splits.related_groups(rows.limit(0), ties).count() == 0
    assert splits.related_groups(rows, ties.limit(0)).count() == 0


def test_splits_keep_groups_and_shares(spark):
    rows = feats(spark, [(i, t(i // 2)) for i in range(6000)] + [(7000 + i, None) for i in range(300)])
    ties = alias(spark, [(t(i, ""), t(i + 1, "")) for i in range(0, 600, 3)])
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0), (None, 1.0), ("odd", float("nan"))], "split_name string, share double")
    got = {r["feat_id"]: r["split_name"] for r in splits.split_rows(rows, ties, shares).collect()}
    assert len(got) == 6300
    n = Counter(got.values())
    assert set(n) == {"train", "validation", "test"} and abs(n["train"] / 6300 - 0.8) < 0.03
    for i in range(0, 600, 3):
        assert len({got[2 * i], got[2 * i + 1], got[2 * i + 2], got[2 * i + 3]}) == 1
    again = {r["feat_id"]: r["split_name"] for r in splits.split_rows(rows.repartition(7), ties, shares).collect()}
    assert got == again
    assert splits.split_rows(rows.limit(0), ties, shares).count() == 0
    assert [tuple(r) for r in splits.split_rows(rows, ties, shares.limit(0)).groupBy("split_name").count().collect()] == [(None, 6300)]


@pytest.mark.parametrize("total", [1, 2, 3, 17, 1000, 4097])
def test_feistel_is_a_permutation(total):
    out = fixed_sample.feistel(np.arange(total), total, 9)
    assert sorted(out) == list(range(total))


def test_fixed_sample(spark):
    rows = [(i, t(i // 2 % 400, "/1" if i % 2 else "/2"), 0.0, i) for i in range(1000)] + [(5000 + i, None) for i in range(50)]
    df = feats(spark, rows)
    all_reads = fixed_sample.fixed_sample(df, ["mapq"], k=10_000)
    assert all_reads.count() == 850 and all_reads.select("read_key").distinct().count() == 850
    got = fixed_sample.fixed_sample(df, ["mapq"], k=100).collect()
    assert len(got) == 100 and sorted(r["position"] for r in got) == list(range(100))
    # the last delivery stands for a read
    assert all(r["feat_id"] >= 200 for r in got if r["read_key"].startswith("chr"))
    small = {r["read_key"] for r in fixed_sample.fixed_sample(df.repartition(5), ["mapq"], k=30).collect()}
    assert small == {r["read_key"] for r in got if r["position"] < 30}
    assert fixed_sample.fixed_sample(df.limit(0), ["mapq"]).count() == 0 and fixed_sample.fixed_sample(df, ["mapq"], k=0).count() == 0


def test_fixed_sample_is_uniform():
    hits = np.zeros(50)
    for seed in range(400):
        hits[np.flatnonzero(fixed_sample.feistel(np.arange(50), 50, seed) < 10)] += 1
    assert abs(hits.mean() - 80) < 1e-9 and hits.std() < 16


def draws(spark, rows):
    return spark.createDataFrame(rows, "draw_id bigint, run_id string, class_code int, share double, floor_rows int, draw_size int")


def test_quota_sample(spark):
    rows = [(i, t(i), float(i % 4 == 0), 1, " r1 " if i % 2 else "R1") for i in range(2000)]
    rows += [(3000 + i, t(i), 1.0, 2) for i in range(10)] + [(4000 + i, None, 1.0) for i in range(5)] + [(5000 + i, t(9000 + i), v) for i, v in enumerate([None, float("nan"), 2.0, 0.5])]
    plan = draws(spark, [(1, "R1", 0, 0.5, 0, 200), (1, "r1", 1, 0.5, 0, 200), (2, "R1", 1, 0.9, 0, 1000), (2, "R1", 0, 0.1, 300, 1000), (3, "zz", 0, 1.0, 0, 5), (4, "R1", 0, None, None, None), (5, None, 1, 1.0, 1, 4)])
    sample, report = quota_sample.quota_sample(feats(spark, rows), plan)
    told = {(r["draw_id"], r["class_code"]): r for r in report.collect()}
    ones = 500 + 7 + 5  # redelivered rows make seven more reads class 1
    assert told[1, 0]["available"] == 2000 - 507 and told[1, 1]["available"] == ones
    assert (told[1, 0]["drawn"], told[1, 1]["drawn"]) == (100, 100)
    assert told[2, 1]["deficit"] == 900 - ones and told[2, 1]["drawn"] == ones and told[2, 0]["drawn"] == 300
    assert told[3, 0]["deficit"] == 5 and told[4, 0]["deficit"] == 0 and told[5, 1]["deficit"] == 4
    got = sample.collect()
    assert len(got) == len({(r["draw_id"], r["feat_id"]) for r in got}) == 100 + 100 + ones + 300
    by = dict((r[0], r[2]) for r in rows)
    assert all(by[r["feat_id"]] == r["class_code"] for r in got)
    none, report = quota_sample.quota_sample(feats(spark, []), plan)
    assert none.count() == 0 and report.where("deficit > 0").count() == 6
    assert quota_sample.quota_sample(feats(spark, rows), plan.limit(0))[1].count() == 0
    halves = draws(spark, [(None, "R1", 0, 1.0, 0, 5), (1, "R1", None, 1.0, 0, 5), (1, "R1", 0, 1.0, 0, 5)])
    assert [(r["draw_id"], r["class_code"], r["drawn"]) for r in quota_sample.quota_sample(feats(spark, rows), halves)[1].collect()] == [(1, 0, 5)]


def test_quota_tops_up_after_a_shortfall(spark):
    df = feats(spark, [(i, t(i), 0.0) for i in range(500)])
    plan = draws(spark, [(1, "R1", 0, 1.0, 0, 400)])
    reads = quota_sample.last_classes(df)
    told = quota_sample.quota_plan(reads, plan)
    assert told.first()["accept"] <= 1.0
    few = quota_sample.accepted(reads, told.withColumn("accept", F.lit(0.2)), "feat_id", 5).count()
    assert 50 < few < 160
    sample, _ = quota_sample.quota_sample(df, plan, oversampling=-0.9)
    assert sample.count() == 400
