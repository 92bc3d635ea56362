"""Pairs of rows of different classes that are each other's nearest row by Euclidean distance, exactly.

Such a pair has an end outside the largest class. So only rows of the other classes ask for their nearest row, and of the rows that they
find, only those of another class are asked back: whether any row is nearer to them than the one that found them. All rows are indexed
and can be found. A kd-tree fitted on a bounded sample cuts the space into cells; a query searches its own cell, then those within reach.
Rows travel in compressed blocks, one copy of each for a round.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators.nearest import LEAST_SAMPLED, MOST_SAMPLE_ROWS, SAMPLE_ROWS, SAMPLED, Tree, _box_distances, stacked
from quillmap.session import stored

#: Rows of a cell, most rows of one search task, and rows of a leaf.
CELL_ROWS, TASK_ROWS, LEAF_ROWS = 24_000, 48_000, 256
#: Rows that are packed at a time, queries that are sent or searched side by side, and distances in one product.
PACK_ROWS, BLOCK, PRODUCTS = 100_000, 4096, 4_000_000
#: The id that stands for no row: any row comes before it.
NOBODY = np.iinfo(np.int64).max


class Cells:
    """A kd-tree over sampled rows, the fullest node split first; ``lows`` and ``highs`` bound the rows of each node, once :meth:`bound` has told them."""

    def __init__(self, points: np.ndarray, most: int):
        dims = points.shape[1]
        # children of each node; a leaf is its own child
        axis, cut, below, above, own = [0], [0.0], [0], [0], {0: points}
        todo = [(-len(points), 0)]
        while todo and len(own) < most:
            _, node = heapq.heappop(todo)
            at = own[node]
            j = int(np.argmax(at.std(0))) if len(at) else 0
            x = at[:, j]
            if len(x) < 2 or x.min() == x.max():
                continue
            middle = float(np.median(x))
            if middle == x.min():  # a value of more than half the rows; it is a side of its own
                middle = float(x[x > middle].min())
            axis[node], cut[node], below[node], above[node] = j, middle, len(axis), len(axis) + 1
            del own[node]
            for side in (x < middle, x >= middle):
                own[len(axis)] = at[side]
                heapq.heappush(todo, (-int(side.sum()), len(axis)))
                below.append(len(axis))
                above.append(len(axis))
                axis.append(0)
                cut.append(np.inf)
        self.axis, self.cut, self.below, self.above = np.array(axis), np.array(cut), np.array(below), np.array(above)
        self.number = np.full(len(axis), -1)
        self.number[list(own)] = np.arange(len(own))
        self.share = np.array([len(x) for x in own.values()]) / max(1, len(points))
        # of nodes that no row is in, none is within reach
        self.lows, self.highs = np.full((len(axis), dims), np.inf), np.full((len(axis), dims), -np.inf)

    def of(self, points: np.ndarray) -> np.ndarray:
        node, live = np.zeros(len(points), int), np.arange(len(points))
        while len(live):
            at = node[live]
            node[live] = np.where(points[live, self.axis[at]] >= self.cut[at], self.above[at], self.below[at])
            live = live[self.number[node[live]] < 0]
        return self.number[node]

    def bound(self, cell: np.ndarray, dim: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        node = np.flatnonzero(self.number >= 0)[np.argsort(self.number[self.number >= 0])][cell]
        self.lows[node, dim], self.highs[node, dim] = low, high
        for node in range(len(self.axis) - 1, -1, -1):  # children come after their parents
            if self.number[node] < 0:
                both = [self.below[node], self.above[node]]
                self.lows[node], self.highs[node] = self.lows[both].min(0), self.highs[both].max(0)

    def reach(self, points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of points and of the cells that may hold a row within their (squared) bounds."""
        q, node, found = np.arange(len(points)), np.zeros(len(points), int), []
        while len(q):
            far = np.zeros(len(q))
            for j in range(points.shape[1]):
                p = points[q, j]
                gap = np.maximum(np.maximum(self.lows[node, j] - p, p - self.highs[node, j]), 0)
                far += gap * gap
            near = np.isfinite(far) & (far <= bounds[q])
            q, node = q[near], node[near]
            leaf = self.number[node] >= 0
            found.append((q[leaf], self.number[node[leaf]]))
            q, node = np.tile(q[~leaf], 2), np.r_[self.below[node[~leaf]], self.above[node[~leaf]]]
        return tuple(np.concatenate([f[i] for f in found]) for i in range(2)) if found else (q, node)


class Plan:
    """What every task needs: the cells, and how many chunks each has (a cell of many equal vectors has several)."""

    def __init__(self, cells: Cells, dims: int, rows: int):
        self.cells, self.dims = cells, dims
        self.chunks = np.maximum(1, np.ceil(cells.share * rows / TASK_ROWS)).astype(int)


def pack(table: np.ndarray) -> bytes:
    """Columns of 8 bytes each, compressed with their bytes sorted by place."""
    whole = np.ascontiguousarray(table).view(np.uint8).reshape(*table.shape, 8)
    return pa.compress(np.ascontiguousarray(whole.transpose(0, 2, 1)).tobytes(), codec="zstd", asbytes=True)


def unpack(block: bytes, columns: int, n: int) -> np.ndarray:
    """The columns of a block, as integers."""
    raw = pa.decompress(block, codec="zstd", decompressed_size=columns * n * 8, asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(columns, 8, n).transpose(0, 2, 1)).view(np.int64)[..., 0]


BLOCKS = "cell int, chunk int, n int, block binary"


def _blocks(parts: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Packs tables whose columns go to the given cells and chunks, one block for each of those."""

    def packed(held: list) -> pa.RecordBatch:
        cell, chunk, table = (np.concatenate(x, axis=-1) for x in zip(*held))
        order = np.lexsort((chunk, cell))
        cell, chunk, table = cell[order], chunk[order], table[:, order]
        starts = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (chunk[1:] != chunk[:-1])])
        ends = np.r_[starts[1:], len(cell)]
        numbers = [pa.array(x.astype(np.int32)) for x in (cell[starts], chunk[starts], ends - starts)]
        return pa.RecordBatch.from_arrays([*numbers, pa.array([pack(table[:, a:b]) for a, b in zip(starts, ends)], pa.binary())], names=["cell", "chunk", "n", "block"])

    held, rows = [], 0
    for part in parts:
        if not len(part[0]):
            continue
        held.append(part)
        rows += len(part[0])
        if rows >= PACK_ROWS:
            yield packed(held)
            held, rows = [], 0
    if held:
        yield packed(held)


def _table(blocks: pd.DataFrame, columns: int) -> np.ndarray:
    return np.concatenate([unpack(b, columns, n) for b, n in zip(blocks["block"], blocks["n"])], axis=1)


def _points(sent):
    """Blocks of ids, classes and vectors."""

    def parts(batches: Iterator[pa.RecordBatch]):
        p: Plan = sent.value
        for batch in batches:
            ids, classes, *values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            vectors = stacked(values)
            cell = p.cells.of(vectors)
            yield cell, (ids * np.int64(2654435761) >> np.int64(7)) % p.chunks[cell], np.vstack([ids, classes, vectors.T.copy().view(np.int64)])

    return lambda batches: _blocks(parts(batches))


def _asking(sent):
    """Blocks of queries that know no row yet, for the chunks of their own cells."""

    def parts(batches: Iterator[pa.RecordBatch]):
        p: Plan = sent.value
        for batch in batches:
            ids, classes, *values = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            vectors = stacked(values)
            yield _sent(p, p.cells.of(vectors), np.vstack([ids, classes, np.full(len(ids), np.inf).view(np.int64), np.full(len(ids), NOBODY), vectors.T.copy().view(np.int64)]))

    return lambda batches: _blocks(parts(batches))


def _sent(p: Plan, cell: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each column of a table for every chunk of its cell."""
    chunks = p.chunks[cell]
    q, cell = np.repeat(np.arange(len(cell)), chunks), np.repeat(cell, chunks)
    return cell, np.arange(len(cell)) - np.repeat(np.cumsum(chunks) - chunks, chunks), table[:, q]


def _bounds(sent):
    """The least and largest value of each cell in each dimension, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p: Plan = sent.value
        for batch in batches:
            ends = [(t.min(1), t.max(1)) for b, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()) for t in [unpack(b, 2 + p.dims, n)[2:].view(float)]]
            if ends:
                low, high = (np.concatenate(x) for x in zip(*ends))
                cell, dim = np.repeat(batch.column(0).to_numpy(), p.dims), np.tile(np.arange(p.dims, dtype=np.int32), len(ends))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (cell, dim, low, high)], names=["cell", "dim", "low", "high"])

    return run


def _targets(sent, home: bool):
    """Blocks of queries for all cells within reach of their bounds; with ``home`` their own too."""

    def parts(batches: Iterator[pa.RecordBatch]):
        p: Plan = sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, BLOCK):
                ids, classes, bound, best, packed = whole.slice(begin, BLOCK).columns
                vectors = np.frombuffer(b"".join(packed.to_pylist()), float).reshape(len(ids), p.dims)
                table = np.vstack([ids.to_numpy(), classes.to_numpy(), bound.to_numpy().copy().view(np.int64), best.to_numpy(), vectors.T.copy().view(np.int64)])
                q, cell = p.cells.reach(vectors, bound.to_numpy())
                wanted = home | (cell != p.cells.of(vectors)[q])
                yield _sent(p, cell[wanted], table[:, q[wanted]])

    return lambda batches: _blocks(parts(batches))


def _lowest_two(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Among equal vectors only the rows of the two lowest ids can be anybody's nearest row."""
    same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1])))[:, 0], return_inverse=True)[1].reshape(-1)
    order = np.lexsort((ids, same))
    order = order[np.r_[True, (same[order][1:] != same[order][:-1]) | (ids[order][1:] != ids[order][:-1])]]
    s = same[order]
    return np.sort(order[np.r_[True, True, s[2:] != s[:-2]][: len(order)]])


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in one order, so that they are the same from either end."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        gap = a[:, j] - b[:, j]
        out += gap * gap
    return out


def search(ids: np.ndarray, vectors: np.ndarray, own: np.ndarray, asked: np.ndarray, bound: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the nearest row with another id, -1 without any before (``bound``, ``best``) in the order of squared distance and id; and its squared distance.

    A query takes its nearest leaf, the next one, and then all leaves within reach of the best row so far. Products in single precision only pick candidates,
    whose distances are then taken exactly.
    """
    tree = Tree(vectors, LEAF_ROWS)
    order = tree.order
    ids, vectors = ids[order], vectors[order]
    short, queries = vectors.astype(np.float32), asked.astype(np.float32)
    norms, lengths = np.einsum("ij,ij->i", short, short), np.einsum("ij,ij->i", queries, queries)
    slack = 1e-5 * (1 + norms.max() + lengths.max())
    at, bound, best = np.full(len(asked), -1), bound.copy(), best.copy()

    def look(who: np.ndarray, leaf: int) -> None:
        a, b = tree.bounds[leaf]
        by = np.argsort(ids[a:b], kind="stable")
        for begin in range(0, len(who), max(1, PRODUCTS // (b - a))):
            q = who[begin : begin + max(1, PRODUCTS // (b - a))]
            d = norms[a:b] - 2 * (queries[q] @ short[a:b].T)
            first, last = (np.searchsorted(ids[a:b][by], own[q], s) for s in ("left", "right"))
            for j in range(int((last - first).max())):
                itself = np.flatnonzero(first + j < last)
                d[itself, by[first[itself] + j]] = np.inf
            r, c = np.nonzero(d <= (np.minimum(d.min(1), bound[q] - lengths[q]) + slack)[:, None])
            other = ids[a + c] != own[q[r]]
            r, c = r[other], c[other]
            far = _squares(vectors[a + c], asked[q[r]])
            least = np.lexsort((ids[a + c], far, r))
            least = least[np.r_[True, r[least][1:] != r[least][:-1]][: len(least)]]
            to, row, far = q[r[least]], a + c[least], far[least]
            won = (far < bound[to]) | ((far == bound[to]) & (ids[row] < best[to]))
            at[to[won]], bound[to[won]], best[to[won]] = row[won], far[won], ids[row[won]]

    for begin in range(0, len(asked), BLOCK):
        block = np.arange(begin, min(begin + BLOCK, len(asked)))
        far = _box_distances(tree.low, tree.high, asked[block])
        for _ in range(2):
            leaf = far.argmin(1)
            near = far[np.arange(len(block)), leaf]
            for one in np.unique(leaf[near <= bound[block]]):
                look(block[(leaf == one) & (near <= bound[block])], one)
            far[np.arange(len(block)), leaf] = np.inf
        for one in range(far.shape[1]):
            who = block[(far[:, one] <= bound[block]) & np.isfinite(far[:, one])]
            if len(who):
                look(who, one)
    return np.where(at < 0, -1, order[at]), bound


FOUND = "query bigint, class bigint, own binary, distance double, id bigint, id_class bigint, found binary"


def _searcher(sent, schema: list[str], all_queries: bool):
    def run(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        p: Plan = sent.value
        if not len(points) or not len(queries):
            return pd.DataFrame({c: [] for c in schema})
        rows, asked = _table(points, 2 + p.dims), _table(queries, 4 + p.dims)
        vectors, own = rows[2:].view(float).T.copy(), asked[4:].view(float).T.copy()
        some = _lowest_two(rows[0], vectors)
        at, distance = search(rows[0][some], vectors[some], asked[0], own, asked[2].view(float), asked[3])
        pick = np.flatnonzero((at >= 0) | all_queries)
        at, asked = at[pick], asked[:, pick]
        row = some[at]
        as_bytes = lambda v: [x.tobytes() for x in v]
        out = {"query": asked[0], "class": asked[1], "own": lambda: as_bytes(own[pick]), "distance": distance[pick], "id": np.where(at < 0, asked[3], rows[0][row])}
        out |= {"id_class": rows[1][row], "found": lambda: as_bytes(vectors[row]), "beaten": at >= 0}
        return pd.DataFrame({c: out[c]() if callable(out[c]) else out[c] for c in schema})

    return run


def _plan(rows: DataFrame, features: list[str], n: int, seed: int) -> Plan:
    size = min(MOST_SAMPLE_ROWS, max(SAMPLE_ROWS, n // SAMPLED))
    sample = rows.sample(min(1.0, size / max(1, n)), seed).limit(2 * size) if n > size else rows
    raw = sample.select(*[F.col(c).cast("double") for c in features]).toPandas()
    points = stacked([raw[c].to_numpy(dtype=float) for c in features])
    return Plan(Cells(points, max(1, min(-(-n // CELL_ROWS), len(points) // LEAST_SAMPLED))), len(features), n)


def mutual_pairs(rows: DataFrame, features: list[str], label: str, row_id: str, seed: int = 17) -> DataFrame:
    """``a`` < ``b``: rows of different ``label`` that are each other's nearest row, the lower id first among equals.

    Rows without an id or a label neither ask nor are found; null and NaN features count as 0.
    """
    spark = rows.sparkSession
    known = rows.where(F.col(row_id).isNotNull() & F.col(label).isNotNull())
    total = known.groupBy(label).count().agg(F.sum("count").alias("n"), F.max_by(label, "count").alias("largest")).first()
    plan = _plan(known, features, total["n"] or 0, seed)
    sent = spark.sparkContext.broadcast(plan)
    values = [F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(f"_f{j}") for j, c in enumerate(features)]
    numbers = [F.col(row_id).cast("bigint").alias("_id"), F.xxhash64(label).alias("_class")]
    points = stored(known.select(*numbers, *values).mapInArrow(_points(sent), BLOCKS))
    ends = points.select("cell", "block", "n").mapInArrow(_bounds(sent), "cell int, dim int, low double, high double")
    ends = ends.groupBy("cell", "dim").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()
    plan.cells.bound(*(ends[c].to_numpy() for c in ("cell", "dim", "low", "high")))
    sent = spark.sparkContext.broadcast(plan)
    tasks = min(int(plan.chunks.sum()), 20_000)

    def visit(queries: DataFrame, schema: str, all_queries: bool) -> DataFrame:
        names = [x.split()[0] for x in schema.split(", ")]
        a, b = (x.repartition(tasks, "cell", "chunk").groupBy("cell", "chunk") for x in (points, queries))
        return a.cogroup(b).applyInPandas(_searcher(sent, names, all_queries), schema)

    def best(found: DataFrame) -> DataFrame:
        least = F.min(F.struct("distance", "id", "id_class", "found")).alias("best")
        return found.groupBy("query").agg(F.first("class").alias("class"), F.first("own").alias("own"), least).select("query", "class", "own", "best.*")

    asking = known.where(F.col(label) != F.lit(total["largest"])).select(*numbers, *values).mapInArrow(_asking(sent), BLOCKS)
    # what the first round found is used twice; it is one row for each query
    first = stored(best(visit(asking, FOUND, True)))
    asking = first.select("query", "class", "distance", "id", "own").mapInArrow(_targets(sent, False), BLOCKS)
    found = best(first.unionByName(visit(asking, FOUND, False))).where(f"class <> id_class AND id <> {NOBODY}")
    # a row that several rows found can only be the other end of the nearest of them
    found = found.groupBy("id").agg(F.min(F.struct("distance", "query")).alias("by"), F.first("found").alias("found"))
    asking = found.select("id", F.col("by.query").alias("by"), "by.distance", F.col("by.query").alias("best"), "found").mapInArrow(_targets(sent, True), BLOCKS)
    answers = visit(asking, "query bigint, class bigint, beaten boolean", True)
    pairs = answers.groupBy("query").agg(F.first("class").alias("by"), F.max("beaten").alias("beaten")).where("NOT beaten")
    return pairs.select(F.least("query", "by").alias("a"), F.greatest("query", "by").alias("b")).distinct()
