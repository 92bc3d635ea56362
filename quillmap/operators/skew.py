"""Joins that stay balanced when one key holds a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16


def hot_buckets(df: DataFrame, key: str, share: float = 0.002, least_rows: int = 200_000) -> dict[int, int]:
    """Hash buckets of ``key`` that hold more than ``share`` of all rows, each with the number of salts it needs.

    Counts combine before the shuffle to at most ``BUCKETS`` rows a task, so the pass costs a scan of one column. At most
    ``1 / share`` buckets can be hot, which bounds the result whatever the size of the input.
    """
    sizes = df.groupBy(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    most = int(1 / share)
    row = sizes.agg(
        F.sum("n").alias("total"),
        F.slice(F.sort_array(F.collect_list(F.struct("n", "bucket")), asc=False), 1, most).alias("top"),
    ).first()
    limit = max(least_rows, (row["total"] or 0) * share)
    return {r["bucket"]: min(1024, -(-r["n"] // int(limit)) + 1) for r in row["top"] or [] if r["n"] > limit}


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: dict[int, int] | None = None) -> DataFrame:
    """``left`` joined to ``right`` on ``key``, hot keys of ``left`` being spread over several tasks.

    ``how`` is inner, left, left_semi or left_anti. Rows of a hot bucket get a salt from their whole content in ``left``
    and are repeated for each salt in ``right``; all other rows join as they are. Null keys match nothing, are kept by left
    and left_anti joins, and are spread like a hot key. The result has the columns of a plain join on ``key``.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    hot = hot_buckets(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    salts = F.create_map(*[F.lit(x) for pair in hot.items() for x in pair])

    def many(df: DataFrame):
        return F.coalesce(F.try_element_at(salts, F.pmod(F.xxhash64(df[key]), F.lit(BUCKETS))), F.lit(1))

    rest = [c for c in left.columns if c != key] or [key]
    a = left.withColumn("_salt", F.pmod(F.xxhash64(*[left[c].cast("string") for c in rest]), many(left)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), many(right) - 1)))
    return a.join(b, [key, "_salt"], how).drop("_salt")
