"""Nearest rows by Euclidean distance, over kd-trees that Spark spreads.

The space is cut into cells by a kd-tree fitted on a bounded sample; every row goes to its cell, and within a cell a finer
kd-tree orders the leaves by their distance from a query. Each query first searches its own cell; its k-th distance then says
which other cells it must visit. A :class:`Space` says where the trees see a row and how far off, in
their space, a nearer row may lie: with the rows' own coordinates the result is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.session import cut

#: Rows of the sample that the cells are fitted on (one in ``SAMPLED`` beyond the least, up to the most), and the fewest of them in a cell.
SAMPLE_ROWS, MOST_SAMPLE_ROWS, SAMPLED, LEAST_SAMPLED = 60_000, 1_000_000, 500, 24
#: Rows of a cell, of one search task and of a leaf.
CELL_ROWS, TASK_ROWS, LEAF_ROWS = 24_000, 48_000, 32
#: Queries that one search task takes, about, and cells that a query visits, about; where a cell expects more
#: queries, its rows are copied and its queries dealt to the copies.
TASK_QUERIES, VISITS = 20_000, 24
#: Queries that a task searches side by side, the most leaves each of them takes between two stopping tests, and pairs of query and leaf in one product.
BLOCK, MOST_LEAVES, PAIRS = 1024, 16, 8192


class Space:
    """Where the trees see a row, and the stopping test: by the rows' own coordinates."""

    def place(self, vectors: np.ndarray) -> np.ndarray:
        return vectors

    def limit(self, bounds: np.ndarray) -> np.ndarray:
        """Squared distance in the trees' space beyond which no row is nearer than ``bounds`` (squared)."""
        return bounds


def _box_distances(lows: np.ndarray, highs: np.ndarray, points: np.ndarray) -> np.ndarray:
    out = np.zeros((len(points), len(lows)))
    for j in range(points.shape[1]):
        p = points[:, j, None]
        gap = np.maximum(np.maximum(lows[:, j] - p, p - highs[:, j]), 0)
        out += gap * gap
    return out


class Cells:
    """A kd-tree over placed rows whose leaves are the cells; ``lows`` and ``highs`` bound each cell."""

    def __init__(self, points: np.ndarray, levels: int):
        self.levels, dims = levels, points.shape[1]
        self.axis = np.zeros((1 << levels) - 1, int)
        self.cut = np.zeros((1 << levels) - 1)
        low, high = np.full(dims, -np.inf), np.full(dims, np.inf)
        self.lows, self.highs = np.empty((1 << levels, dims)), np.empty((1 << levels, dims))
        self.share = np.empty(1 << levels)
        self._split(points, 0, low, high, max(1, len(points)))

    def _split(self, points: np.ndarray, node: int, low: np.ndarray, high: np.ndarray, total: int) -> None:
        inner = len(self.axis)
        if node >= inner:
            at = node - inner
            self.lows[at], self.highs[at], self.share[at] = low, high, len(points) / total
            return
        axis = int(np.argmax(points.std(0))) if len(points) > 1 else 0
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        left = points[:, axis] < cut
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        self._split(points[left], 2 * node + 1, low, below, total)
        self._split(points[~left], 2 * node + 2, above, high, total)

    def of(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), int)
        for _ in range(self.levels):
            right = points[np.arange(len(points)), self.axis[node]] >= self.cut[node]
            node = 2 * node + 1 + right
        return node - len(self.axis)

    def far(self, points: np.ndarray) -> np.ndarray:
        """Squared distances of points from the boxes of all cells."""
        return _box_distances(self.lows, self.highs, points)


class Tree:
    """Rows of one search task in leaves of a kd-tree over their places."""

    def __init__(self, points: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order, self.bounds, todo = np.arange(len(points)), [], [(0, len(points))]
        while todo:
            a, b = todo.pop()
            own = points[order[a:b]]
            spread = own.max(0) - own.min(0)
            axis = int(np.argmax(spread))
            if b - a <= leaf_rows or spread[axis] == 0:
                self.bounds.append((a, b))
                continue
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        self.order = order
        self.low = np.array([points[order[a:b]].min(0) for a, b in self.bounds])
        self.high = np.array([points[order[a:b]].max(0) for a, b in self.bounds])


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, groups: np.ndarray, asked: np.ndarray, placed: np.ndarray, own: np.ndarray, k: int, bounds: np.ndarray, space: Space):
    """Ids and squared distances of the ``k`` nearest rows of other groups within ``bounds`` (squared) of each query, and how many rows were verified.

    Each query takes the leaves in order of their distance from it, a few at a time; all rows of a leaf are verified with true distances.
    Before each step the stopping test compares the next leaves with the k-th distance so far. Queries go side by side; products
    in single precision only pick candidates, whose distances are then taken exactly.
    ``vectors``, ``ids`` and ``groups`` are in the order of the tree.
    """
    n, dims = asked.shape
    best_d, best_i, seen = np.full((n, k), np.inf), np.full((n, k), -1, np.int64), np.zeros(n, np.int64)
    bound = bounds.astype(float).copy()
    starts, sizes = np.array([a for a, _ in tree.bounds]), np.array([b - a for a, b in tree.bounds])
    # leaves of one size, filled up with rows that are nobody's neighbours
    at = starts[:, None] + np.arange(sizes.max())
    filler = at >= (starts + sizes)[:, None]
    at = np.where(filler, 0, at)
    short = vectors.astype(np.float32)
    leaves, leaf_groups, leaf_norms = short[at], groups[at], np.where(filler, np.inf, np.einsum("ij,ij->i", short, short)[at]).astype(np.float32)
    queries = asked.astype(np.float32)
    norms = np.einsum("ij,ij->i", queries, queries)
    slack = 1e-5 * (1 + np.einsum("ij,ij->i", short, short).max() + (norms.max() if n else 0))
    for first in range(0, n, BLOCK):
        far = _box_distances(tree.low, tree.high, placed[first : first + BLOCK])
        order = np.argsort(far, axis=1, kind="stable")
        far = np.take_along_axis(far, order, 1)
        live, begin, width = np.arange(len(far)), 0, 1
        while len(live) and begin < far.shape[1]:
            open_ = far[live, begin : begin + width] <= space.limit(bound[first + live])[:, None]
            q, leaf = np.broadcast_to(live[:, None], open_.shape)[open_] + first, order[live, begin : begin + width][open_]
            seen += np.bincount(q, sizes[leaf], n).astype(np.int64)
            got_q, got_r = [], []
            for a in range(0, len(q), PAIRS):
                who, where = q[a : a + PAIRS], leaf[a : a + PAIRS]
                d = leaf_norms[where] - 2 * np.matmul(leaves[where], queries[who, :, None])[:, :, 0] + norms[who, None]
                # a filler is infinitely far, which no bound is before k rows are found
                r, c = np.nonzero((d <= bound[who, None] + slack) & (d < np.inf) & (leaf_groups[where] != own[who, None]))
                got_q.append(who[r])
                got_r.append(at[where[r], c])
            if got_q:
                _merge(np.concatenate(got_q), np.concatenate(got_r), vectors, ids, asked, k, bound, best_d, best_i)
            live = live[open_[:, -1]]
            begin += width
            width = min(2 * width, MOST_LEAVES)
    return best_i, best_d, seen


def _merge(q: np.ndarray, rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, bound: np.ndarray, best_d: np.ndarray, best_i: np.ndarray) -> None:
    diff = vectors[rows] - asked[q]
    d = np.einsum("ij,ij->i", diff, diff)
    keep = d <= bound[q]
    q, d, i = q[keep], d[keep], ids[rows[keep]]
    here = np.unique(q)
    q, d, i = np.concatenate([q, np.repeat(here, k)]), np.concatenate([d, best_d[here].ravel()]), np.concatenate([i, best_i[here].ravel()])
    by = np.lexsort((i, d, q))
    q, d, i = q[by], d[by], i[by]
    new = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    keep = place < k
    best_d[q[keep], place[keep]], best_i[q[keep], place[keep]] = d[keep], i[keep]
    bound[here] = np.minimum(bound[here], best_d[here, -1])


def stacked(columns: list[np.ndarray]) -> np.ndarray:
    """Columns as vectors; null and NaN count as 0."""
    return np.nan_to_num(np.column_stack(columns).astype(float), nan=0.0)


class Plan:
    """What every task needs: how columns become vectors, the space of the trees and the cells."""

    def __init__(self, vectors: Callable, space: Space, dtype: str, cells: Cells, rows: int, queries: int):
        self.vectors, self.space, self.dtype, self.cells = vectors, space, np.dtype(dtype), cells
        self.chunks = np.maximum(1, np.ceil(cells.share * rows / TASK_ROWS)).astype(int)
        self.copies = np.maximum(1, np.ceil(cells.share * queries * min(VISITS, len(cells.share)) / TASK_QUERIES)).astype(int)

    def unpack(self, packed) -> np.ndarray:
        return np.frombuffer(b"".join(packed), self.dtype).reshape(len(packed), -1).astype(float)


def _plan(rows: DataFrame, queries: DataFrame, features: list[str], vectors: Callable, space: Space, dtype: str, seed: int) -> Plan:
    n = rows.count()
    size = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, n // SAMPLED))
    sample = rows.sample(min(1.0, size / max(1, n)), seed).limit(2 * size) if n > size else rows
    raw = sample.select(*[F.col(c).cast("double") for c in features]).toPandas()
    points = space.place(vectors([raw[c].to_numpy(dtype=float) for c in features]))
    most = max(1, min(-(-n // CELL_ROWS), len(points) // LEAST_SAMPLED))
    return Plan(vectors, space, dtype, Cells(points, (most - 1).bit_length()), n, n if queries is rows else queries.count())


POINTS = "cell int, chunk int, copies int, id bigint, grp bigint, vector binary"


def _indexed(rows: DataFrame, features: list[str], row_id: str, group: Column, sent) -> DataFrame:
    """Every row with its cell, one of the cell's chunks (a cell of many equal vectors has several) and its vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            vectors = p.vectors([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]).astype(p.dtype)
            cell = p.cells.of(p.space.place(vectors.astype(float)))
            chunk = (ids * np.int64(2654435761) >> np.int64(7)) % p.chunks[cell]
            ends = pa.py_buffer((np.arange(len(ids) + 1) * p.dtype.itemsize * vectors.shape[1]).astype(np.int32).tobytes())
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(ids), [None, ends, pa.py_buffer(vectors.tobytes())])
            numbers = [pa.array(x.astype(np.int32)) for x in (cell, chunk, p.copies[cell])]
            yield pa.RecordBatch.from_arrays([*numbers, batch.column(0), batch.column(1), packed], names=["cell", "chunk", "copies", "id", "grp", "vector"])

    values = [F.col(c).cast("double").alias(f"_f{j}") for j, c in enumerate(features)]
    return rows.select(F.col(row_id).cast("bigint").alias("_id"), group.cast("bigint").alias("_group"), *values).mapInArrow(run, POINTS)


FOUND = "query bigint, id bigint, distance double, seen bigint"


def _searcher(sent, k: int, work: bool):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        p: Plan = sent.value
        none = np.zeros(0, np.int64)
        if not len(points) or not len(queries):
            return pd.DataFrame({"query": none, "id": none, "distance": none.astype(float), "seen": none})
        vectors, asked = p.unpack(points["vector"]), p.unpack(queries["vector"])
        tree = Tree(p.space.place(vectors))
        ids, groups = points["id"].to_numpy()[tree.order], points["grp"].to_numpy()[tree.order]
        bounds = queries["bound"].to_numpy()
        i, d, seen = search(tree, vectors[tree.order], ids, groups, asked, p.space.place(asked), queries["grp"].to_numpy(), k, bounds, p.space)
        q = queries["id"].to_numpy()
        if work:
            return pd.DataFrame({"query": q, "id": np.int64(0), "distance": 0.0, "seen": seen})
        fine = np.isfinite(d)
        return pd.DataFrame({"query": np.repeat(q, fine.sum(1)), "id": i[fine], "distance": d[fine], "seen": 0})

    return run


QUERIES = "cell int, chunk int, copy int, id bigint, grp bigint, vector binary, bound double"


def _targets(sent, home: bool):
    """Sends each query to the chunks of its own cell, or to those of all other cells within reach of its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(begin, BLOCK)
                own, bound = batch.column(0).to_numpy(), batch.column(4).to_numpy()
                if home:
                    q, cell = np.arange(len(own)), own
                else:
                    far = p.cells.far(p.space.place(p.unpack(batch.column(3).to_pylist())))
                    far[np.arange(len(far)), own] = np.inf
                    q, cell = np.nonzero(np.isfinite(far) & (far <= p.space.limit(bound)[:, None]))
                chunks = p.chunks[cell]
                q, cell = np.repeat(q, chunks), np.repeat(cell, chunks)
                chunk = np.arange(len(cell)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                at = batch.take(pa.array(q))
                copy = at.column(1).to_numpy() % p.copies[cell]
                numbers = [pa.array(x.astype(np.int32)) for x in (cell, chunk, copy)]
                yield pa.RecordBatch.from_arrays([*numbers, *at.columns[1:]], names=["cell", "chunk", "copy", "id", "grp", "vector", "bound"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    # what a query has is a few rows from each cell it visited
    best = F.slice(F.array_sort(F.collect_list(F.struct("distance", "id"))), 1, k)
    return found.groupBy("query").agg(best.alias("best"))


def nearest_rows(
    rows: DataFrame,
    features: list[str],
    k: int,
    row_id: str,
    group: Column | None = None,
    queries: DataFrame | None = None,
    wanted: Column | None = None,
    vectors: Callable = stacked,
    space: Space | None = None,
    dtype: str = "float64",
    seed: int = 17,
    work: bool = False,
) -> DataFrame:
    """``query``, ``id`` and ``distance`` of the ``k`` nearest rows of each query row, the lower id first among equals.

    Queries are rows of the table: those whose id is in ``queries`` (null, repeated and unknown ids count for nothing), or
    those that ``wanted`` keeps; all, if neither is given. All rows are indexed and searched. Rows of a query's own
    ``group`` (by default the row itself) are no neighbours. A query has fewer than ``k`` rows only if the table has no more.
    Rows without an id neither ask nor are found.
    With ``work`` the result is ``query`` and ``verified``, the number of rows whose true distance was taken.
    """
    spark = rows.sparkSession
    rows = rows.where(F.col(row_id).isNotNull())
    asked = rows if wanted is None else rows.where(wanted)
    if queries is not None:
        probe = queries.select(row_id).where(F.col(row_id).isNotNull()).distinct()
        # ids of eight bytes; beyond a million the two are joined by shuffle
        asked = asked.join(F.broadcast(probe) if probe.limit(1_000_001).count() <= 1_000_000 else probe, row_id, "left_semi")
    group = F.col(row_id) if group is None else group
    plan = _plan(rows, asked, features, vectors, space or Space(), dtype, seed)
    sent = spark.sparkContext.broadcast(plan)
    at = ["cell", "chunk", "copy"]
    # where a cell expects more queries than a task should take, its rows are copied and its queries dealt to the copies
    copy = F.explode(F.sequence(F.lit(0), F.col("copies") - 1)) if plan.copies.max() > 1 else F.lit(0)
    points = _indexed(rows, features, row_id, group, sent).select("cell", "chunk", copy.alias("copy"), "id", "grp", "vector")
    asked = _indexed(asked, features, row_id, group, sent).select("cell", "id", "grp", "vector")
    # as many tasks as there are cells, whatever their bytes: a task's work does not follow its bytes
    tasks = min(int((plan.chunks * plan.copies).sum()), 20_000)

    def visit(who: DataFrame, home: bool, work: bool = False) -> DataFrame:
        to = who.select("cell", "id", "grp", "vector", "bound").mapInArrow(_targets(sent, home), QUERIES)
        a, b = points.repartition(tasks, *at).groupBy(*at), to.repartition(tasks, *at).groupBy(*at)
        return a.cogroup(b).applyInPandas(_searcher(sent, k, work), FOUND)

    start = asked.withColumn("bound", F.lit(float("inf")))
    # what the first round found is used twice; it is a few rows for each query
    first = cut(_best(visit(start, True), k))
    bound = first.select(F.col("query").alias("id"), F.when(F.size("best") >= k, F.element_at("best", -1)["distance"]).alias("_bound"))
    known = asked.join(bound, "id", "left").withColumn("bound", F.coalesce("_bound", F.lit(float("inf"))))
    if work:
        return visit(start, True, True).unionAll(visit(known, False, True)).groupBy("query").agg(F.sum("seen").alias("verified"))
    both = visit(known, False).select("query", "id", "distance").unionAll(first.select("query", F.explode("best").alias("b")).select("query", "b.id", "b.distance"))
    return _best(both, k).select("query", F.explode("best").alias("b")).select("query", "b.id", F.sqrt("b.distance").alias("distance"))
