"""Problem 3: the most similar vectors for every vector.

Vectors are projected to a few dimensions by a seeded Gaussian (2-stable) matrix, so the squared projected distance over the
squared true distance follows a chi-square law. The projected space is indexed by kd-trees; leaves are visited in order of their
projected distance from the query and their rows verified with true distances, until the chi-square test says that a row
not yet seen is unlikely to be nearer than the k-th best.
"""

from __future__ import annotations

from math import exp

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.names import read_key
from quillmap.operators.nearest import Space, nearest_rows

#: Dimensions of the projection.
DIMS = 6
#: Level of the stopping test: a row nearer than the k-th best so far would by now have come up with at least this chance.
#: Whole leaves are verified, so more true neighbours are found than the level says.
SURE = 0.75


def chi_square(x: float, dims: int) -> float:
    """Distribution function of chi-square for an even number of dimensions."""
    term, total = 1.0, 0.0
    for i in range(dims // 2):
        total += term
        term *= x / 2 / (i + 1)
    return 1.0 - exp(-x / 2) * total


def chi_square_point(p: float, dims: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


class StableProjection(Space):
    """Rows are placed by a Gaussian matrix. The stopping test: for a row at a distance of d, the squared distance of its place over d
    squared is chi-square with as many degrees of freedom as the places have dimensions."""

    def __init__(self, features: int, dims: int, sure: float, seed: int):
        self.matrix = np.random.default_rng(seed).normal(size=(features, dims))
        self.point = chi_square_point(sure, dims)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix

    def limit(self, bounds: np.ndarray) -> np.ndarray:
        return self.point * bounds


class Scale:
    """Which columns make a vector: (value - centre) / spread, null and NaN first replaced by the fallback."""

    def __init__(self, rows: list):
        self.features = [r["feature"] for r in rows]
        self.centre, self.spread, self.fallback = (np.array([r[c] for r in rows], float) for c in ("centre", "spread", "fallback"))

    def vectors(self, columns: list[np.ndarray]) -> np.ndarray:
        raw = np.column_stack(columns).astype(float)
        return (np.where(np.isnan(raw), self.fallback, raw) - self.centre) / self.spread


def scale_of(featscale: DataFrame) -> Scale:
    """A table of one row a feature; features without name or with a spread of 0, null or NaN are left out."""
    rows = featscale.where("feature IS NOT NULL AND spread <> 0 AND NOT isnan(spread) AND centre IS NOT NULL AND fallback IS NOT NULL").orderBy("feature").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("at most 1,000 features make a vector")
    return Scale(rows)


def similar_rows(
    rows: DataFrame, featscale: DataFrame, queries: DataFrame | None = None, wanted: Column | None = None, k: int = 5, seed: int = 17, row_id: str = "feat_id", name: str = "read_name", sure: float = SURE, work: bool = False
) -> DataFrame:
    """``query``, ``id`` and ``distance`` of the ``k`` most similar rows of other reads for each query row.

    Queries are rows of the table: those whose id is in ``queries`` (a column named as ``row_id``; null, repeated and
    unknown ids count for nothing), or those that the condition ``wanted`` keeps; all, if neither is given. All rows are
    indexed and searched. Redelivered rows of a query's own read are no neighbours; a row without a name is a read of its own.
    Among rows equally far the lower id comes first. Vectors are held as float32, so distances are exact to about seven
    digits. A query has fewer than ``k`` rows only if the table has no more rows of other reads; an empty table gives none.
    Rows without an id neither ask nor are found. Without any feature that has a scale there are no vectors, and no rows come out.

    The test stops a search once the nearest unseen leaf lies so far off in the projection that a row nearer than the k-th best
    would be projected nearer with the chance ``sure``; the same test keeps a query from cells that far away. With ``work`` the
    result is ``query`` and ``verified``, the number of rows whose true distance was taken for it.
    """
    scale = scale_of(featscale)
    if not scale.features:
        return rows.sparkSession.createDataFrame([], "query bigint, verified bigint" if work else "query bigint, id bigint, distance double")
    return nearest_rows(
        rows, scale.features, k, row_id, F.xxhash64(read_key(F.col(name), F.col(row_id))), queries, wanted,
        vectors=scale.vectors, space=StableProjection(len(scale.features), DIMS, sure, seed), dtype="float32", seed=seed, work=work,
    )
