"""Reads as a stream: recalibration against a table of scores, deliveries counted once, and counts by arrival time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators.recalibrate import recalibrated


def recalibrated_stream(reads: DataFrame, scores: DataFrame) -> DataFrame:
    """A stream of reads joined to a table of scores, as in the batch query."""
    return recalibrated(reads, scores)


def _timed(reads: DataFrame) -> DataFrame:
    # watermarks need a time with a zone
    return reads.withColumn("arrived_at", F.col("arrived_at").cast("timestamp"))


def first_deliveries(reads: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Each read once, while its repetition arrives within ``lateness``; older state is dropped."""
    return _timed(reads).withWatermark("arrived_at", lateness).dropDuplicatesWithinWatermark(["read_name"])


def arrival_counts(reads: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Reads and mean MAPQ by window of arrival; rows later than ``lateness`` are left out by the watermark."""
    own = _timed(reads).withWatermark("arrived_at", lateness).groupBy(F.window("arrived_at", window).alias("w"))
    return own.agg(F.count(F.lit(1)).alias("reads"), F.avg("mapq").alias("mapq")).select(*[F.col(f"w.{c}").cast("timestamp_ntz").alias(c) for c in ("start", "end")], "reads", "mapq")
