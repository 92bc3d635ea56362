"""Sorting, concatenation, differences of pools and streams over the reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions.names import cleaned
from quillmap.operators import features
from quillmap.plans.read_queries import LABEL, USABLE
from quillmap.sources.tables import table
from quillmap.streaming import arrivals


def coordinate_sorted(spark, d):
    """All placed reads in coordinate order: a range shuffle and a sort within each range."""
    rows = table(spark, d, "reads").where("contig_idx IS NOT NULL").select("contig_idx", "begin_pos", "ord")
    return rows.repartitionByRange("contig_idx", "begin_pos", "ord").sortWithinPartitions("contig_idx", "begin_pos", "ord")


def top_positions(spark, d):
    """The ten first placed reads in coordinate order, as a top-k report."""
    rows = table(spark, d, "reads").where("contig_idx IS NOT NULL").select("contig_idx", "begin_pos", "ord")
    return rows.orderBy("contig_idx", "begin_pos", "ord").limit(10)


def concat_contigs(spark, d):
    """Calls of both copies put together, counted by contig code."""
    both = table(spark, d, "vcf_main").select("chrom").unionByName(table(spark, d, "vcf_mirror").select("chrom"))
    return both.groupBy(F.regexp_replace(cleaned(F.col("chrom")), "^chr", "").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def pool_except(spark, d):
    """Well aligned reads that MAPQ 20 and more already tells right leave the pool."""
    rows = features.labelled(table(spark, d, "reads")).select("ord", "label", "mapq")
    right = rows.where("label = 0 AND mapq >= 20").select("ord")
    return rows.where("label = 0").join(right, "ord", "left_anti").select("ord", "mapq")


def arrival_counts(spark, d):
    """The streaming aggregate, run as a batch over the whole table."""
    return arrivals.arrival_counts(table(spark, d, "reads"), "1 day")


def truth_by_run(spark, d):
    rows = features.labelled(table(spark, d, "reads"))
    return rows.groupBy(cleaned(F.col("run_id")).alias("run")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == 1).alias("misaligned"))


QUERIES = {
    "coordinate_sort": (coordinate_sorted, "SELECT contig_idx, begin_pos, ord FROM reads WHERE contig_idx IS NOT NULL ORDER BY ALL"),
    "coordinate_sort_topn": (top_positions, "SELECT contig_idx, begin_pos, ord FROM reads WHERE contig_idx IS NOT NULL ORDER BY ALL LIMIT 10"),
    "concat_contigs": (
        concat_contigs,
        "SELECT regexp_replace(lower(trim(chrom)), '^chr', '') AS code, count(*) AS n FROM (SELECT chrom FROM vcf_main UNION ALL SELECT chrom FROM vcf_mirror) GROUP BY 1",
    ),
    "pool_except": (pool_except, f"SELECT ord, mapq FROM (SELECT ord, mapq, {LABEL} AS label {USABLE}) WHERE label = 0 AND (mapq < 20) IS NOT FALSE"),
    "truth_by_run": (
        truth_by_run,
        f"SELECT regexp_replace(lower(run_id), '^\\s+|\\s+$', '', 'g') AS run, count(*) AS n, count(*) FILTER (label = 1) AS misaligned FROM (SELECT run_id, {LABEL} AS label {USABLE}) GROUP BY 1",
    ),
    "arrival_counts": (
        arrival_counts,
        """SELECT time_bucket(INTERVAL 1 DAY, arrived_at) AS "start", time_bucket(INTERVAL 1 DAY, arrived_at) + INTERVAL 1 DAY AS "end", count(*) AS reads, avg(mapq) AS mapq
        FROM reads WHERE arrived_at IS NOT NULL GROUP BY 1, 2""",
    ),
}
