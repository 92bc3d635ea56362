"""Every query of the core with SQL, in Spark and in DuckDB, over the smallest tables; the others run and have their columns.

Those in ``SLOW`` fit many models; their operators are tested in ``test_models.py`` and ``test_ensemble_queries.py``.
"""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from quillmap.plans.registry import CORE
from quillmap.sources.schemas import FEATURE_FILE

SF = "/root/testdata/sf0.001"
SLOW = {"train_undersample", "train_second_stage", "train_rusboost", "train_easy_ensemble", "train_gbt_searched"}
REPORT = {"model", "metric", "value"}
COLUMNS = {
    "sequence_features": {"ord", "read_gc_content", "read_complexity_score", "qual_intercept", "qual_slope", "qual_r_value", "read_eigenval_1", "read_eigenval_2", "read_trace", "read_det"},
    "reference_features": {"ord", "ref_gc_content", "ref_complexity_score", "ref_eigenval_1", "ref_eigenval_2", "ref_trace", "ref_det"},
    "full_vector": {"ord", "read_name", *FEATURE_FILE}, "complexity_zlib": {"ord", "zlib_6", "zlib_9"}, "seq_invariants": {"ord", "eigenval_1", "eigenval_2", "trace", "det"},
    "predicted_scores": {"feat_id", "mapq_new", "predicted"}, "rerank_positives": {"feat_id", "score"},
}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    rel = db.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    at = [rel.columns.index(c) for c in df.columns]
    got = Counter(tuple(map(plain, r)) for r in df.collect())
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in CORE.items() if sql is None and n not in SLOW))
def test_runs(spark, name):
    rows = entry.queries()[name](spark, SF)
    assert set(rows.columns) == COLUMNS.get(name, REPORT) and rows.count() > 0
