"""Micro-tables with values worked out by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmap.functions import names, reads, sequences
from quillmap.functions.variant_values import allele, alternatives, contig_code, quality_cents
from quillmap.operators import features, recalibrate

COLUMNS = (
    "ord bigint, qname string, read_name string, contig string, contig_idx int, begin_pos int, is_unmapped boolean, is_rc boolean, mate_rc boolean, mapq int, tlen int, "
    "as_ int, xs int, ys int, xg int, nm int, xm int, xo int, yt string, qual string, seq string"
)


def read(ord=1, qname="c1-100-,c1-130-D:c2-260-::1", contig="c1", idx=0, pos=101, unmapped=False, rc=False, mate_rc=True, mapq=30, tlen=5, as_=-3, xs=-9, yt="CP", qual="5555", seq="ACGT"):
    return (ord, qname, f"{qname}/1", contig, idx, pos, unmapped, rc, mate_rc, mapq, tlen, as_, xs, None, None, None, None, None, yt, qual, seq)


def one(spark, expr, **kw):
    return spark.createDataFrame([read(**kw)], COLUMNS).select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("p, q", [(1.0, 0), (0.5, 3), (0.1, 9), (0.01, 19), (1e-5, 50), (1e-8, 80), (0.0, 50), (None, None), (math.nan, None), (1.5, None)])
def test_phred(spark, p, q):
    assert spark.createDataFrame([(p,)], "p double").select(reads.phred(F.col("p")).alias("q")).first()["q"] == q


@pytest.mark.parametrize(
    "kw, label",
    [
        ({}, 0),
        ({"pos": 103}, 1),
        ({"contig": "c2", "pos": 259}, 0),
        ({"contig": "c3"}, 1),
        ({"qname": "nothing"}, None),
        ({"qname": "c1-x-:c1-y-::3"}, None),
        ({"qname": ""}, None),
        ({"qname": None}, None),
        ({"contig": None, "pos": None}, 1),
    ],
)
def test_origin_label(spark, kw, label):
    assert one(spark, reads.misplaced_label(), **kw) == label


def test_low_quality_bases(spark):
    q = "".join(chr(33 + x) for x in (10, 20, 30, 19))
    assert one(spark, reads.low_quality_count(), qual=q) == 2
    assert one(spark, reads.low_quality_mean(), qual=q) == 14.5
    for empty in ("??", "", None):
        assert one(spark, reads.low_quality_count(), qual=empty) == 0
        assert one(spark, reads.low_quality_mean(), qual=empty) == 40.0


def test_filters_and_defaults(spark):
    rows = [read(1), read(2, as_=-3, xs=-3), read(3, as_=None, xs=None), read(4, unmapped=True), read(5, idx=None, contig=None, pos=None), read(6, yt="??")]
    df = spark.createDataFrame(rows, COLUMNS)
    got = {r["ord"]: r for r in features.feature_vector(df).collect()}
    assert sorted(got) == [1, 3, 6]
    assert got[3]["alignment_scores_diff"] == 75
    assert got[6]["pair_alignment_type"] is None
    assert got[1]["pair_orientation"] == 0 and got[1]["insert_size"] == 1
    counts = features.read_counters(df).first().asDict()
    assert counts == {"reads": 6, "unmapped": 2, "multi_mapped": 1, "misaligned": 0, "well_aligned": 3}


def test_lag_over_stretches(spark):
    quals = ["5", "$$", "$", "$$$"]
    rows = [read(i, pos=p, qual=q) for i, (p, q) in enumerate(zip((5, 99_000, 250_000, 250_001), quals))] + [read(9, idx=1, pos=7)]
    got = {r["ord"]: r["n_low_qual_bases"] for r in features.lagged_features(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 1, 9: 0}


def test_last_score_wins(spark):
    scores = spark.createDataFrame([("a", 5, 1), ("a", 9, 2), ("b", None, 3), (None, 1, 4)], "read_name string, mapq_new int, ord bigint")
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z"), (None, 4, "w")], "read_name string, mapq int, mapq_other string")
    got = recalibrate.recalibrated(df, scores).collect()
    assert sorted((r[0] or "", r[1], r[2]) for r in got) == [("", 4, "w"), ("a", 9, "x"), ("a", 9, "y"), ("b", 3, "z")]


def test_quality_line(spark):
    up = "".join(chr(33 + i) for i in range(1, 91))
    df = spark.createDataFrame([(1, up), (2, "?" * 100), (3, "5"), (4, ""), (5, None)], "i int, q string")
    got = {r["i"]: r["l"] for r in df.select("i", sequences.quality_line("q").alias("l")).collect()}
    assert np.allclose(list(got[1]), [0, 1, 1])
    assert np.isclose(got[2]["intercept"], 30) and got[2]["slope"] == 0 and got[2]["r"] is None
    assert all(v is None for i in (3, 4, 5) for v in got[i])


def test_sequence_functions(spark):
    seqs = ["ACGTACGGTN", "AAAA", "", None, "acgt" * 30, "NNN"]
    df = spark.createDataFrame(list(enumerate(seqs)), "i int, s string")
    got = {r["i"]: r for r in df.select("i", sequences.gc_content(F.col("s")).alias("gc"), sequences.gc_content_without_n(F.col("s")).alias("n"), sequences.distance_matrix("s").alias("m"), sequences.sequence_invariants("s").alias("v"), sequences.zlib_length(6)("s").alias("z")).collect()}
    assert got[0]["gc"] == 0.5 and np.isclose(got[0]["n"], 5 / 9) and got[2]["gc"] is None and got[5]["n"] is None
    for i in (0, 1, 4):
        s = seqs[i].upper()
        for a in range(4):
            for b in range(4):
                d = [abs(x - y) for x, p in enumerate(s) for y, q in enumerate(s) if p == "ACGT"[a] and q == "ACGT"[b]]
                assert np.isclose(got[i]["m"][a * 4 + b], np.mean(d) if d else 0)
    assert got[2]["m"] is None and got[3]["m"] is None and got[3]["z"] is None
    assert got[1]["v"]["trace"] is None and got[5]["v"]["det"] is None
    m = np.array(got[0]["m"]).reshape(4, 4)
    m = (m - m.min()) / (m.max() - m.min())
    e = np.linalg.eigvalsh(m)
    assert np.allclose(list(got[0]["v"]), [e[3], e[2], np.trace(m), e.prod()])


def test_names(spark):
    df = spark.createDataFrame([(" Chr1-5-C:chr1-9-D::77/1\t", 1), ("chr1-5-c:chr1-9-d::77_2", 2), ("chr1-5-C:chr1-9-D::77 1:N:0", 3), ("odd", 4), (" ", 5), (None, 6)], "n string, i bigint")
    got = df.select(names.template(F.col("n")).alias("t"), names.mate(F.col("n")).alias("m"), names.read_key(F.col("n"), F.col("i")).alias("k")).collect()
    assert [r["t"] for r in got] == ["chr1-5-c:chr1-9-d::77"] * 3 + ["odd", None, None]
    assert [r["m"] for r in got[:4]] == ["1", "2", "1", ""]
    assert got[0]["k"] == got[2]["k"] != got[1]["k"] and got[4]["k"] == "row 5" and got[5]["k"] == "row 6"


def test_variant_values(spark):
    df = spark.createDataFrame([(" CHR07", "a,g", "1.2345e+1"), ("7 ", "G,A", "12,35"), ("chromosome_X", "", " . "), (None, None, "nan"), ("chr", "t", "x")], "c string, a string, q string")
    got = df.select(contig_code(F.col("c")), alternatives(F.col("a")), quality_cents(F.col("q")), allele(F.col("a"))).collect()
    assert [r[0] for r in got] == ["7", "7", "x", None, "chr"]
    assert [r[1] for r in got] == ["A,G", "A,G", None, None, "T"]
    assert [r[2] for r in got] == [1235, 1235, None, None, None]
