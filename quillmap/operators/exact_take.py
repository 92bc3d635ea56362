"""Taking an exact number of rows from each group in a random order, however large a group is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the random key; a group is spread over as many tasks.
RANGES = 4096


def random_key(seed: int, *columns: Column) -> Column:
    """A uniform key from 0 to 2^63 - 1, the same on every run and every cluster."""
    return F.xxhash64(F.lit(seed), *columns).bitwiseAND(F.lit((1 << 63) - 1))


def uniform(key: Column) -> Column:
    """The random key as a number from 0 to 1."""
    return key.cast("double") / F.lit(float(1 << 63))


def last_taken(df: DataFrame, groups: list[str], key: str, tie: str, quota: DataFrame) -> DataFrame:
    """``groups``, ``_last_key`` and ``_last_tie`` of the last row of each group among its ``quota`` smallest; the last row of all, if there are fewer.

    One row a group. Only the range of the key where that row lies is ranked. Groups with a null quota or one below 1 are left out.
    """
    at = F.shiftright(F.col(key), 63 - 12).cast("int")
    rows = df.withColumn("_at", at)
    sizes = rows.groupBy(*groups, "_at").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_at"))
    total = F.sum("_n").over(Window.partitionBy(*groups))
    wanted = sizes.withColumn("_upto", upto).withColumn("_total", total).join(quota.where("quota >= 1").select(*groups, F.col("quota").cast("bigint").alias("_quota")), groups)
    wanted = wanted.withColumn("_quota", F.least("_quota", "_total")).where("_upto >= _quota AND _upto - _n < _quota")
    there = wanted.select(*groups, "_at", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_at").orderBy(key, tie))
    ranked = rows.join(there, [*groups, "_at"]).withColumn("_rank", rank).where("_rank = _need")
    return ranked.select(*groups, F.col(key).alias("_last_key"), F.col(tie).alias("_last_tie"))


def take_smallest(df: DataFrame, groups: list[str], key: str, tie: str, quota: DataFrame) -> DataFrame:
    """The rows of each group with the smallest ``key``; ``quota`` has the groups and ``quota``, the number to take.

    Counts by range of the key say which ranges are taken whole and in which one the last row lies; only within that
    range are rows ranked (by ``key``, then ``tie``). So no task ever sorts a group. Groups that ``quota`` lacks, or whose
    quota is null or below 1, give no rows; a group smaller than its quota gives all its rows.
    """
    at = F.shiftright(F.col(key), 63 - 12).cast("int")
    sizes = df.withColumn("_at", at).groupBy(*groups, "_at").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_at"))
    ranges = (
        sizes.withColumn("_upto", upto)
        .join(quota.select(*groups, F.col("quota").cast("bigint").alias("_quota")), groups)
        .where(F.col("_upto") - F.col("_n") < F.col("_quota"))
        .select(*groups, "_at", (F.col("_quota") - F.col("_upto") + F.col("_n")).alias("_need"), "_n")
    )
    rows = df.withColumn("_at", at).join(ranges, [*groups, "_at"])
    whole = rows.where("_n <= _need")
    rank = F.row_number().over(Window.partitionBy(*groups, "_at").orderBy(key, tie))
    last = rows.where("_n > _need").withColumn("_rank", rank).where("_rank <= _need").drop("_rank")
    return whole.unionByName(last).drop("_at", "_need", "_n")
