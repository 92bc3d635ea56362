"""Replacing the mapping quality of reads by new scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_scores(scores: DataFrame) -> DataFrame:
    """One score for each name: that with the highest ``ord``, even if it is null; rows without a name are dropped."""
    return scores.where("read_name IS NOT NULL").groupBy("read_name").agg(F.max_by("mapq_new", "ord").alias("mapq_new"))


def recalibrated(reads: DataFrame, scores: DataFrame) -> DataFrame:
    """All columns of all reads, ``mapq`` replaced where the read's name has a score. The side to build is left to the optimiser."""
    new = last_scores(scores)
    return reads.join(new, "read_name", "left").withColumn("mapq", F.coalesce("mapq_new", "mapq")).drop("mapq_new").select(*reads.columns)


def mapq_before_after(reads: DataFrame, scores: DataFrame) -> DataFrame:
    """Reads by MAPQ before and after."""
    both = reads.select("read_name", "mapq").join(last_scores(scores), "read_name", "left")
    ends = F.explode(F.array(F.struct(F.lit("before").alias("stage"), "mapq"), F.struct(F.lit("after").alias("stage"), F.coalesce("mapq_new", "mapq").alias("mapq"))))
    return both.select(ends.alias("x")).groupBy("x.stage", "x.mapq").agg(F.count(F.lit(1)).alias("n"))
