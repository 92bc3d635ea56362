"""Relational operators against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.operators import experiment, intervals, metrics, sampling, skew
from quillmap.operators.exact_take import random_key, take_smallest
from quillmap.operators.nearest import nearest_rows
from quillmap.operators.table_diff import latest, peel, table_diff


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    left = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(600)] + [(None, -1)], "k string, v int")
    right = spark.createDataFrame([("hot", 1), ("k3", 2), ("k3", 3), ("k6", None), (None, 9)], "k string, w int")
    hot = skew.hot_buckets(left, "k", share=0.1, least_rows=10)
    assert len(hot) == 1
    got = skew.salted_join(left, right, "k", how, hot)
    want = left.join(right, "k", how)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_take_smallest(spark):
    rows = [(g, i) for g, n in (("a", 500), ("b", 3), ("c", 10), (None, 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int").withColumn("k", random_key(1, F.col("g"), F.col("i")))
    quota = spark.createDataFrame([("a", 123), ("b", 9), ("c", 0), ("z", 5)], "g string, quota bigint")
    got = take_smallest(df, ["g"], "k", "i", quota).collect()
    keys = sorted((r["k"], r["i"]) for r in df.where("g = 'a'").collect())
    assert {r["i"] for r in got if r["g"] == "a"} == {i for _, i in keys[:123]}
    assert sum(r["g"] == "b" for r in got) == 3 and not any(r["g"] == "c" for r in got)
    same = df.withColumn("k", F.lit(7).cast("bigint"))
    assert {r["i"] for r in take_smallest(same, ["g"], "k", "i", quota).where("g = 'a'").collect()} == set(range(123))


def _diff(spark, a, b, **kw):
    schema = "k string, n int, v string, w double"
    out = table_diff(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), ["k", "n"], ["v", "w"], **kw)
    return sorted((r["k"] or "", r["n"] or 0, r["field"], r["main_value"], r["mirror_value"]) for r in out.collect())


def test_table_diff_cases(spark):
    a = [("a", 1, "x", 1.0), ("b", 1, None, 2.0), ("c", 1, "y", None), (None, 2, "n", 1.0), ("e", 1, "", 0.0)]
    b = [("a", 1, "x", 1.0), ("b", 1, "z", 2.5), ("d", 1, "y", None), (None, 2, "m", 1.0), ("e", 1, None, 0.0)]
    want = [("", 2, "v", "n", "m"), ("b", 1, "v", None, "z"), ("b", 1, "w", "2.0", "2.5"), ("c", 1, "only_main", None, None), ("d", 1, "only_mirror", None, None), ("e", 1, "v", "", None)]
    assert _diff(spark, a, b) == sorted(want, key=str) or _diff(spark, a, b) == sorted(want)
    assert _diff(spark, a, a) == [] and _diff(spark, [], []) == []
    assert {r[2] for r in _diff(spark, a, [])} == {"only_main"} and len(_diff(spark, [], b)) == 5


def test_table_diff_beyond_its_cells(spark):
    """More differences than the cells can hold: larger tables, then a plain comparison of the buckets."""
    a = [(f"k{i}", i, "x", 1.0) for i in range(3000)]
    b = [(f"k{i}", i, "x" if i % 2 else "y", 1.0) for i in range(3000)]
    for rounds in (1, 3):
        got = _diff(spark, a, b, cells=96, rounds=rounds)
        assert len(got) == 1500 and {r[2] for r in got} == {"v"}


def test_latest(spark):
    df = spark.createDataFrame([("a", 1, "old", 1), ("a", 1, "new", 2), ("a", None, "none", 5)], "k string, t int, v string, o int")
    assert [tuple(r) for r in latest(df, ["k"], ["v"], ["t", "o"]).collect()] == [("a", "new")]


def test_depth_is_the_naive_join(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1]), rng.choice([10, 11, 65_530, 65_536, 131_000]) + rng.randint(0, 60), "A" * rng.choice([30, 40])) for i in range(300)] + [(999, None, None, "A")]
    df = spark.createDataFrame(rows, "ord bigint, contig_idx int, begin_pos int, seq string")
    got = {r["ord"]: r["depth"] for r in intervals.with_depth(df).collect()}
    placed = [r for r in rows if r[1] is not None]
    want = {}
    for o, c, b, s in placed:
        m = b + len(s) // 2
        want[o] = sum(1 for _, c2, b2, s2 in placed if c2 == c and b2 < m + 10 and b2 + len(s2) > m - 10)
    assert got == want


def test_reference_pieces(spark):
    text = "".join(random.Random(1).choices("ACGT", k=1000))
    genome = spark.createDataFrame([(0, i, text[i * 64 : (i + 1) * 64]) for i in range(16)], "contig_idx int, chunk_no bigint, seq string")
    win = spark.createDataFrame([(1, 0, 0, 10), (2, 0, 60, 300), (3, 0, 990, 1000), (4, 7, 0, 5)], "ord bigint, contig_idx int, left int, right int")
    got = {r["ord"]: r["piece"] for r in intervals.reference_pieces(win, genome, 64).collect()}
    assert got == {1: text[:10], 2: text[60:300], 3: text[990:]}


def test_reference_features(spark):
    from quillmap.operators import features

    text = "".join(random.Random(1).choices("ACGT", k=1000))
    genome = spark.createDataFrame([(0, i, text[i * 64 : (i + 1) * 64]) for i in range(16)], "contig_idx int, chunk_no bigint, seq string")
    contigs = spark.createDataFrame([(0, "c", 1000)], "contig_idx int, name string, length int")
    reads = spark.createDataFrame([(1, 0, 500, "A" * 100, False, 0, 5), (2, None, None, "A", True, 0, 5)], "ord bigint, contig_idx int, begin_pos int, seq string, is_unmapped boolean, as_ int, xs int")
    got = features.reference_features(reads, contigs, genome, 64).collect()
    window = text[375:725]
    assert len(got) == 1 and got[0]["ref_gc_content"] == sum(c in "CG" for c in window) / 350 and got[0]["ref_eigenval_1"] > got[0]["ref_eigenval_2"]


def test_pileup(spark):
    rows = [(0, 5, False, "ACG", "III"), (0, 6, False, "CT", "I!"), (0, 6, False, "TT", "II"), (0, 6, False, "TT", "II"), (None, None, True, "A", "I"), (0, 1, False, "", "")]
    df = spark.createDataFrame(rows, "contig_idx int, begin_pos int, is_unmapped boolean, seq string, qual string")
    counts = intervals.allele_counts(df)
    assert {(r["pos"], r["base"]): r["n"] for r in counts.collect()} == {(5, "A"): 1, (6, "C"): 2, (7, "G"): 1, (6, "T"): 2, (7, "T"): 2}
    assert {r["pos"] for r in intervals.variable_positions(counts).collect()} == {6}


def test_replicates_through_the_chain(spark):
    """Names 0-9 cover place 100 with A or C; recalibration brings in what was below the limit; every replicate takes all names."""
    rows = [(f"n{i}", f"n{i}", 1, 100, False, "A" if i % 2 else "C", "I", 30 if i < 2 else 10, 50, 0) for i in range(10)]
    rows += [(f"m{i}", f"m{i}", 1, 200, False, "AC"[i % 2], "I", 10, 50, 0) for i in range(4)] + [("u", "u", 1, 300, True, "A", "I", 30, 50, 0), (None, None, 2, None, None, None, None, None, None, None)]
    reads = spark.createDataFrame(rows, "read_name string, qname string, contig_idx int, begin_pos int, is_unmapped boolean, seq string, qual string, mapq int, as_ int, xs int")
    scores = spark.createDataFrame([(f"m{i}", 40, i) for i in range(4)] + [("n0", 40, 9), (None, 1, 10)], "read_name string, mapq_new int, ord bigint")
    truth = spark.createDataFrame([(1, 100), (1, 100), (1, 900), (None, 5)], "contig_idx int, pos int")
    got = experiment.replicate_rates(experiment.replicate_sites(reads, scores, [1, 2], 1.0), truth, [1, 2]).orderBy("replicate").collect()
    for r in got:
        assert (r["tp_before"], r["fp_before"], r["fn_before"]) == (1, 0, 1) and (r["tp_after"], r["fp_after"], r["fn_after"]) == (1, 1, 1)
        assert r["precision_before"] == 1 and r["precision_change"] == -50 and r["recall_change"] == 0
    none = experiment.replicate_rates(experiment.replicate_sites(reads.limit(0), scores, [1], 1.0), truth, [1]).collect()
    assert [(r["replicate"], r["tp_after"], r["fn_after"], r["precision_after"]) for r in none] == [(1, 0, 2, None)]


def test_average_precision(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.3, 0), (0.2, 1), (None, 1), (0.1, None)], "score double, label int")
    assert round(metrics.average_precision(df).first()[0], 6) == 0.755556
    many = spark.range(5000).select((F.pow(F.rand(3), 9)).alias("score"), (F.rand(4) < 0.3).cast("int").alias("label")).persist()
    rows = sorted(((r["score"], r["label"]) for r in many.collect()), reverse=True)
    hits = np.cumsum([y for _, y in rows])
    assert np.isclose(metrics.average_precision(many).first()[0], sum(h / (i + 1) for i, (h, (_, y)) in enumerate(zip(hits, rows)) if y) / hits[-1])
    assert metrics.average_precision(df.limit(0)).first()[0] is None
    same = spark.createDataFrame([(0.5, 1), (0.5, 0)], "score double, label int")
    assert metrics.average_precision(same).first()[0] == 0.5


def test_empty_metrics(spark):
    none = spark.createDataFrame([], "score double, label int, predicted int")
    row = metrics.rates(metrics.confusion(none)).first()
    assert row["f1_1"] is None and row["accuracy"] is None
    assert metrics.calibration_curve(none).count() == 0 and metrics.score_histogram(none).count() == 0


def test_minmax(spark):
    df = spark.createDataFrame([(1, 1.0, 5.0), (2, 3.0, 5.0), (3, None, 5.0), (4, float("nan"), None)], "i int, a double, b double")
    got = {r["i"]: (r["a"], r["b"]) for r in metrics.minmax_scaled(df, ["a", "b"], ("i",)).collect()}
    assert got == {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (None, 0.0), 4: (None, None)}


def test_sampling(spark):
    df = spark.createDataFrame([(i, int(i % 10 == 0) if i % 100 != 7 else None) for i in range(2000)], "i bigint, y int")
    split = sampling.stratified_split(df, "y", "i")
    n = {(r["y"], r["is_train"]): r["n"] for r in split.groupBy("y", "is_train").agg(F.count("*").alias("n")).collect()}
    assert n == {(1, True): 40, (1, False): 160, (0, True): 356, (0, False): 1424}
    assert {r["y"]: r["count"] for r in sampling.undersampled(df, "y", "i").groupBy("y").count().collect()} == {0: 200, 1: 200}
    ranked = sampling.rank_within(df.where("y IS NOT NULL"), ["y"], "i", 1)
    assert sorted(r["number"] for r in ranked.where("y = 1").collect()) == list(range(200))
    told = df.withColumn("p", (F.col("i") % 7 == 0).cast("int"))
    pools = {r["pool"]: r["count"] for r in sampling.resampled_pools(told, "y", "p", "i", factor=2).groupBy("pool").count().collect()}
    fp = told.where("y = 0 AND p = 1").count()
    assert pools == {"FN": 1, "TN": 1, "FP": fp - 1, "TP": 2 * fp - 1}
    assert sampling.undersampled(df.limit(0), "y", "i").count() == 0


def test_nearest_is_exact(spark, monkeypatch):
    from quillmap.operators import nearest

    monkeypatch.setattr(nearest, "CELL_ROWS", 60)
    monkeypatch.setattr(nearest, "LEAST_SAMPLED", 8)
    monkeypatch.setattr(nearest, "TASK_ROWS", 50)
    monkeypatch.setattr(nearest, "TASK_QUERIES", 100)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 3))
    x[:250] = x[0]  # a third of all rows are one point
    rows = [(i, *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "i bigint, a double, b double, c double")
    got: dict[int, list[int]] = {}
    for r in nearest_rows(df, ["a", "b", "c"], 4, "i").orderBy("query", "distance", "id").collect():
        got.setdefault(r["query"], []).append(r["id"])
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    for q in range(700):
        order = sorted((d[q, j], j) for j in range(700) if j != q)[:4]
        assert got[q] == [j for _, j in order]
    assert nearest_rows(df.limit(0), ["a", "b", "c"], 4, "i").count() == 0
    holes = df.where("i < 300").withColumn("i", F.when(F.col("i") % 3 > 0, F.col("i")))
    found = nearest_rows(holes, ["a", "b", "c"], 4, "i").collect()
    assert len(found) == 800 and all(r["query"] % 3 and r["id"] % 3 for r in found)


def test_peel_gives_up():
    import pandas as pd

    cells = pd.DataFrame([(0, 2, 5, 6, 7), (1, 1, 5, 6, 7)], columns=["_cell", "_count", "_kh", "_rh", "_check"])
    assert peel(cells, 8) == ([], False)
    assert peel(cells.iloc[:0], 8) == ([], True)
