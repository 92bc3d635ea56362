"""Problem 2: a uniform sample of fixed size from data whose size isn't known.

Reads are numbered densely through partition offsets; a seeded Feistel permutation with cycle walking shuffles the numbers
0..N-1, and the reads whose permuted number is below k are the sample.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions.names import read_key
from quillmap.session import cut


#: Partitions that rows are numbered in, at least and at most; a partition has about so many rows between the two.
LEAST_PARTS, MOST_PARTS, PART_ROWS = 4096, 1 << 18, 1_000_000


def dense_numbers(df: DataFrame, key: str) -> tuple[DataFrame, int]:
    """``df`` with ``number`` from 0 to N - 1, and N. ``key`` must be unique.

    Rows are dealt to ``partitions`` by the hash of their key; the counts of the partitions (all that the driver sees) give
    each its offset, and rows are ranked by key within their partition. The numbers depend on the data alone, not on
    tasks, their order or their repetition.
    """
    spark = df.sparkSession
    partitions = min(MOST_PARTS, max(LEAST_PARTS, df.count() // PART_ROWS))
    dealt = df.withColumn("_part", F.pmod(F.xxhash64(key, F.lit("part")), F.lit(partitions)).cast("int"))
    sizes = dict(dealt.groupBy("_part").agg(F.count(F.lit(1))).collect())
    offsets, total = [], 0
    for part in range(partitions):
        offsets.append((part, total))
        total += sizes.get(part, 0)
    at = F.broadcast(spark.createDataFrame(offsets, "_part int, _offset bigint"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(key)) - 1
    numbered = dealt.withColumn("_rank", rank).join(at, "_part").withColumn("number", F.col("_offset") + F.col("_rank"))
    return numbered.drop("_part", "_rank", "_offset"), total


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    # a 64-bit mixer; unsigned arithmetic wraps
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def feistel(numbers: np.ndarray, total: int, seed: int, rounds: int = 6) -> np.ndarray:
    """A permutation of 0..total-1: a Feistel network over the next even number of bits, walked until it falls below ``total``."""
    half = max(1, -(-max(1, (total - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in np.random.SeedSequence(seed).generate_state(rounds, np.uint64)]
    out = numbers.astype(np.uint64)
    walk = np.ones(len(out), bool)
    while walk.any():
        x = out[walk]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        out[walk] = (left << shift) | right
        walk = out >= np.uint64(total)
    return out.astype(np.int64)


def permuted(total: int, seed: int):
    @F.pandas_udf("bigint")
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series(feistel(numbers.to_numpy(), total, seed))

    return run


def last_deliveries(rows: DataFrame, values: list[str], row_id: str = "feat_id", name: str = "read_name", arrived: str = "arrived_at") -> DataFrame:
    """One row for each read: ``read_key`` and the ``values`` of its last arrived row (then the highest row id)."""
    last = F.max_by(F.struct(row_id, *values), F.struct(arrived, row_id)).alias("_v")
    return rows.groupBy(read_key(F.col(name), F.col(row_id)).alias("read_key")).agg(last).select("read_key", "_v.*")


def shuffled(rows: DataFrame, values: list[str], seed: int = 7, row_id: str = "feat_id", name: str = "read_name", arrived: str = "arrived_at") -> DataFrame:
    """Every read as its last arrived row: ``read_key``, the row id, ``values``, ``number`` (0 to N - 1) and ``position``, its place in the permutation.

    Rows without a name are reads of their own; null values stay null; an empty table gives no rows.
    """
    # written once: what is numbered must be what is joined, and the count comes first
    reads = cut(last_deliveries(rows, values, row_id, name, arrived))
    numbered, total = dense_numbers(reads, "read_key")
    return numbered.withColumn("position", permuted(max(1, total), seed)("number"))


def fixed_sample(
    rows: DataFrame, values: list[str], k: int = 1000, seed: int = 7, row_id: str = "feat_id", name: str = "read_name", arrived: str = "arrived_at"
) -> DataFrame:
    """``k`` reads (all, if fewer), every read equally likely however often it was delivered, as its last arrived row.

    Gives ``read_key``, the row id, ``values`` and ``position``, the place in the permutation; a smaller k with the same seed
    gives a prefix. Rows without a name are reads of their own; null values stay null; an empty table or k below 1 gives no rows.
    """
    return shuffled(rows, values, seed, row_id, name, arrived).where(F.col("position") < max(0, k)).drop("number")
