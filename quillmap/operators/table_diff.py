"""Differences between two copies of a table, found through invertible Bloom lookup tables.

Each copy is summed up in buckets of cells: a row adds its key hash and row hash to three cells of its key's bucket. The
cells of one copy minus those of the other hold only what differs, and peeling cells with a single entry reveals the
differing keys. Only the rows of those keys are then fetched and compared field by field. What crosses the network for the
comparison are cells, whose number follows the differences, not the rows.
"""

from __future__ import annotations

import struct
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.skew import salted_join
from quillmap.session import cut, stored

#: Cells that each entry is added to; each has its own third of a bucket's cells.
HASHES = 3
MASK = (1 << 64) - 1


def latest(df: DataFrame, keys: list[str], values: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order`` (null first); combines before the shuffle, so a key may repeat freely."""
    last = F.max_by(F.struct(*values), F.struct(*order)).alias("_v")
    return df.groupBy(*keys).agg(last).select(*keys, "_v.*")


def _text(column: str) -> Column:
    # the hash passes over nulls, so a null gets a writing of its own
    return F.coalesce(F.concat(F.lit("v"), F.col(column).cast("string")), F.lit("n"))


def _hashed(df: DataFrame, keys: list[str], values: list[str], buckets: int) -> DataFrame:
    kh = F.xxhash64(*[_text(c) for c in keys])
    return df.select(
        *keys,
        *values,
        kh.alias("_kh"),
        F.xxhash64(*[_text(c) for c in [*keys, *values]], F.lit("row")).alias("_rh"),
        F.pmod(F.xxhash64(kh, F.lit("bucket")), F.lit(buckets)).cast("int").alias("_bucket"),
    )


def _slots(kh: Column, rh: Column, third: int) -> list[Column]:
    mixed = kh.bitwiseXOR(rh)
    return [
        (F.shiftrightunsigned(mixed, 21 * j).bitwiseAND(F.lit((1 << 21) - 1)) % F.lit(third) + F.lit(j * third)).cast("int")
        for j in range(HASHES)
    ]


def iblt_cells(main: DataFrame, mirror: DataFrame, cells: int) -> DataFrame:
    """Cells of ``main`` minus those of ``mirror``; both have ``_bucket``, ``_kh`` and ``_rh``. Empty cells are left out."""
    third = cells // HASHES
    both = main.select("_bucket", "_kh", "_rh", F.lit(1).alias("_sign")).unionAll(
        mirror.select("_bucket", "_kh", "_rh", F.lit(-1).alias("_sign"))
    )
    slots = F.explode(F.array(*_slots(F.col("_kh"), F.col("_rh"), third))).alias("_cell")
    return (
        both.select("_bucket", "_kh", "_rh", "_sign", F.xxhash64("_kh", "_rh").alias("_check"), slots)
        .groupBy("_bucket", "_cell")
        .agg(
            F.sum("_sign").alias("_count"),
            F.bit_xor("_kh").alias("_kh"),
            F.bit_xor("_rh").alias("_rh"),
            F.bit_xor("_check").alias("_check"),
        )
        .where("_count <> 0 OR _kh <> 0 OR _rh <> 0 OR _check <> 0")
    )


def _check(kh: int, rh: int) -> int:
    """The same number that ``xxhash64(_kh, _rh)`` gives in Spark."""
    import xxhash

    first = xxhash.xxh64_intdigest(struct.pack("<q", kh), 42)
    second = xxhash.xxh64_intdigest(struct.pack("<q", rh), first)
    return second - (1 << 64) if second >> 63 else second


def peel(cells: pd.DataFrame, third: int) -> tuple[list[int], bool]:
    """Key hashes in one bucket's cells, and whether every cell came out empty."""
    table = {c: [n, kh, rh, ck] for c, n, kh, rh, ck in cells[["_cell", "_count", "_kh", "_rh", "_check"]].itertuples(index=False)}
    todo, found = list(table), []
    while todo:
        cell = table.get(todo.pop())
        if cell is None or cell[0] not in (1, -1):
            continue
        sign, kh, rh, check = cell
        if _check(kh, rh) != check:
            continue
        found.append(kh)
        mixed = (kh ^ rh) & MASK
        for j in range(HASHES):
            at = ((mixed >> (21 * j)) & ((1 << 21) - 1)) % third + j * third
            other = table.setdefault(at, [0, 0, 0, 0])
            other[0] -= sign
            other[1] ^= kh
            other[2] ^= rh
            other[3] ^= check
            if other == [0, 0, 0, 0]:
                del table[at]
            else:
                todo.append(at)
        # an entry that comes back is no progress: the table can't be resolved
        if len(found) > 4 * (len(cells) + 1):
            break
    return found, not table


def _peeler(third: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        keys, whole = peel(pdf, third)
        keys = sorted(set(keys)) if whole else [None]
        return pd.DataFrame({"_bucket": [key[0]] * len(keys), "_kh": pd.array(keys, dtype="Int64"), "_open": [not whole] * len(keys)})

    return run


def differing_keys(main: DataFrame, mirror: DataFrame, cells: int = 1536, rounds: int = 3) -> tuple[DataFrame, DataFrame | None]:
    """Key hashes that differ, and the buckets whose cells could not be resolved after ``rounds`` of four times as many cells.

    A bucket's cells are bounded by ``cells * 4 ** (rounds - 1)``, which bounds what one peeling task holds.
    """
    found, left = None, None
    for step in range(rounds):
        size = cells * 4**step
        third = size // HASHES

        a, b = (main, mirror) if left is None else (x.join(left, "_bucket", "left_semi") for x in (main, mirror))
        out = cut(iblt_cells(a, b, size).groupBy("_bucket").applyInPandas(_peeler(third), "_bucket int, _kh bigint, _open boolean"))
        got = out.where("NOT _open").select("_kh")
        found = got if found is None else found.unionAll(got)
        left = out.where("_open").select("_bucket")
        if left.isEmpty():
            return found, None
    return found, left


def table_diff(
    main: DataFrame, mirror: DataFrame, keys: list[str], values: list[str], rows_per_bucket: int = 8_000, cells: int = 1536, rounds: int = 3
) -> DataFrame:
    """Rows missing on either side and values that differ, field by field.

    Gives the key columns, ``field`` (``only_main``, ``only_mirror``, or a name from ``values``), ``main_value`` and
    ``mirror_value`` as text. Both tables must have one row for each key (see :func:`latest`). Null equals null, and null
    against a value differs; null keys match null keys. Extra columns are ignored, whatever their names. Empty tables are
    tables without rows: each row of the other side is missing. Buckets that don't resolve are compared row by row, so the
    result is exact up to a collision of 64-bit row hashes of one key (chance 2^-64 for each changed row).
    """
    # written once, as columns: the counts, the cells and the fetch each read what they need
    a, b = stored(main.select(*keys, *values)), stored(mirror.select(*keys, *values))
    buckets = max(1, -(-max(a.count(), b.count()) // rows_per_bucket))
    a, b = _hashed(a, keys, values, buckets), _hashed(b, keys, values, buckets)
    found, left = differing_keys(a, b, cells, rounds)
    found = found.distinct()

    def fetch(df: DataFrame) -> DataFrame:
        rows = df.join(found, "_kh", "left_semi")
        if left is not None:
            rows = rows.unionByName(salted_join(df, left, "_bucket", "left_semi").join(found, "_kh", "left_anti"))
        return rows.select(F.struct(*keys).alias("k"), "_kh", F.struct(*values).alias("v"))

    x, y = fetch(a).alias("x"), fetch(b).alias("y")
    both = x.join(y, (F.col("x._kh") == F.col("y._kh")) & F.col("x.k").eqNullSafe(F.col("y.k")), "full_outer")
    k = F.coalesce("x.k", "y.k")

    def case(field: str, when: Column, p: Column, q: Column) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), p.cast("string").alias("main_value"), q.cast("string").alias("mirror_value")))

    none = F.lit(None).cast("string")
    here, there = F.col("x._kh").isNotNull(), F.col("y._kh").isNotNull()
    cases = [case("only_main", ~there, none, none), case("only_mirror", ~here, none, none)] + [
        case(c, here & there & ~F.col(f"x.v.{c}").eqNullSafe(F.col(f"y.v.{c}")), F.col(f"x.v.{c}"), F.col(f"y.v.{c}")) for c in values
    ]
    return both.select(k.alias("k"), F.explode(F.array_compact(F.array(*cases))).alias("d")).select("k.*", "d.*")
