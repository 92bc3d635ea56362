"""Sampling of reads and of training rows; every draw is a function of a row's key and a seed.

Keys are md5 digests: uniform, the same in any engine, and independent of partitions and of repeated tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.operators.exact_take import last_taken, take_smallest
from quillmap.operators.features import labelled
from quillmap.session import cut


def draw(key: Column, seed: int) -> Column:
    """A uniform number from 0 to 2^32 - 1."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")


def below(key: Column, seed: int, share: Column) -> Column:
    return draw(key, seed) < share * F.lit(float(1 << 32))


def balanced_reads(reads: DataFrame, seed: int = 1) -> DataFrame:
    """All misaligned reads, and well aligned ones each with the chance misaligned / well aligned (at most 1).

    Two passes: the ratio is one row, sent to all tasks; the sample itself needs no shuffle.
    """
    rows = labelled(reads)
    ratio = rows.agg((F.count_if(F.col("label") == 1) / F.nullif(F.count_if(F.col("label") == 0), F.lit(0))).alias("_ratio"))
    keep = (F.col("label") == 1) | ((F.col("label") == 0) & below(F.col("ord"), seed, F.least(F.col("_ratio"), F.lit(1.0))))
    return rows.crossJoin(F.broadcast(ratio)).where(keep).drop("_ratio")


def replicates(reads: DataFrame, seeds: list[int], share: float, name: str = "qname") -> DataFrame:
    """Down-samples by name, one for each seed, in one pass; mates stay together. ``replicate`` is the seed."""
    kept = F.array_compact(F.array(*[F.when(below(F.col(name), s, F.lit(share)), F.lit(s)) for s in seeds]))
    return reads.withColumn("replicate", F.explode(kept))


def stratified_split(rows: DataFrame, label: str, row_id: str, train_share: float = 0.2, seed: int = 1) -> DataFrame:
    """``is_train`` for exactly ``train_share`` (rounded down) of each class; rows without a class are left out."""
    key = _spread(F.col(row_id), seed)
    # classes and keys alone are written once: what makes a label may cost much
    keys = cut(rows.where(F.col(label).isNotNull()).select(label, row_id, key.alias("_key")))
    quota = keys.groupBy(label).agg(F.floor(F.count(F.lit(1)) * F.lit(train_share)).alias("quota"))
    last = last_taken(keys, [label], "_key", row_id, quota)
    # each row is compared with the last one that its class gives to training: one row a class
    whole = keys if rows.columns in ([row_id, label], [label, row_id]) else rows.where(F.col(label).isNotNull()).withColumn("_key", key)
    taken = (F.col("_key") < F.col("_last_key")) | ((F.col("_key") == F.col("_last_key")) & (F.col(row_id) <= F.col("_last_tie")))
    return whole.join(last, label, "left").select(*rows.columns, F.coalesce(taken, F.lit(False)).alias("is_train"))


def undersampled(rows: DataFrame, label: str, row_id: str, factor: float = 1.0, seed: int = 1) -> DataFrame:
    """All rows of the smaller class and a random ``factor`` times as many of the larger (all, if fewer)."""
    rows = rows.where(F.col(label).isNotNull()).withColumn("_key", _spread(F.col(row_id), seed))
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    least = sizes.agg(F.min("n").alias("least"))
    quota = sizes.crossJoin(F.broadcast(least)).select(label, F.when(F.col("n") == F.col("least"), F.col("n")).otherwise(F.floor(F.col("least") * factor)).alias("quota"))
    return take_smallest(rows, [label], "_key", row_id, quota).drop("_key")


def _spread(key: Column, seed: int) -> Column:
    # the draw in the upper bits of a 63-bit key, as take_smallest wants it
    return F.shiftleft(draw(key, seed), 31)


def resampled_pools(rows: DataFrame, truth: str, predicted: str, row_id: str, factor: int = 2, seed: int = 1) -> DataFrame:
    """Draws with replacement from the pools FN, TN, FP and TP: one each, one each, |FP| - 1 and |FP| * factor - 1 draws.

    Rows of a pool are numbered by random key within ranges of the key, and the drawn numbers are joined to them.
    """
    pool = F.when(F.col(truth) == 1, F.when(F.col(predicted) == 1, "TP").otherwise("FN")).otherwise(F.when(F.col(predicted) == 1, "FP").otherwise("TN"))
    rows = rows.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).select(F.col(row_id), pool.alias("pool"))
    numbered = rank_within(rows, ["pool"], row_id, seed)
    sizes = rows.groupBy("pool").agg(F.count(F.lit(1)).alias("n"))
    fp = sizes.where("pool = 'FP'").select(F.col("n").alias("fp"))
    want = F.when(F.col("pool").isin("FN", "TN"), F.lit(1)).when(F.col("pool") == "FP", F.col("fp") - 1).otherwise(F.col("fp") * factor - 1)
    plan = sizes.join(F.broadcast(fp), how="left").withColumn("want", F.greatest(F.coalesce(want, F.lit(0)), F.lit(0))).where("want > 0")
    draws = plan.select("pool", "n", F.explode(F.sequence(F.lit(1), F.col("want"))).alias("draw_no"))
    draws = draws.withColumn("number", (draw(F.concat_ws("|", "pool", "draw_no"), seed) % F.col("n")).cast("bigint"))
    return draws.select("pool", "draw_no", "number").join(numbered, ["pool", "number"]).select("pool", "draw_no", row_id)


def rank_within(rows: DataFrame, groups: list[str], row_id: str, seed: int, ranges: int = 4096) -> DataFrame:
    """``number`` from 0 in each group in a random order; a group is ranked in ranges of the key, whose offsets are summed first."""
    from pyspark.sql import Window

    key = draw(F.col(row_id), seed)
    rows = rows.withColumn("_key", key).withColumn("_at", F.floor(F.col("_key") / ((1 << 32) // ranges)))
    sizes = rows.groupBy(*groups, "_at").agg(F.count(F.lit(1)).alias("_n"))
    offset = F.sum("_n").over(Window.partitionBy(*groups).orderBy("_at")) - F.col("_n")
    offsets = sizes.select(*groups, "_at", offset.alias("_offset"))
    rank = F.row_number().over(Window.partitionBy(*groups, "_at").orderBy("_key", row_id)) - 1
    return rows.withColumn("_rank", rank).join(offsets, [*groups, "_at"]).withColumn("number", F.col("_offset") + F.col("_rank")).drop("_key", "_at", "_rank", "_offset")
