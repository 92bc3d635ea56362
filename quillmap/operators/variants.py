"""Variant calls against a truth set, before and after recalibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["chrom", "pos", "ref_allele", "alt_allele"]


def is_snp(ref: Column, alt: Column) -> Column:
    """One reference base, and every alternative one base (or the deletion mark)."""
    return (F.length(ref) == 1) & F.forall(F.split(alt, ","), lambda a: F.upper(a).isin("A", "C", "G", "T", "N", "*"))


def classified(calls: DataFrame, truth: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Every distinct call or truth with ``outcome`` TP, FP or FN, matched on contig, position and alleles (and ``by``)."""
    keys = [*by, *KEY]
    a = calls.groupBy(*keys).agg(F.max("qual").alias("qual"), F.max("is_snp").alias("is_snp"))
    b = truth.groupBy(*keys).agg(F.max("is_snp").alias("_truth_snp"), F.lit(True).alias("_in_truth"))
    both = a.withColumn("_called", F.lit(True)).join(b, keys, "full_outer")
    outcome = F.when(F.col("_called").isNull(), "FN").when(F.col("_in_truth").isNull(), "FP").otherwise("TP")
    return both.select(*keys, "qual", F.coalesce("is_snp", "_truth_snp").alias("is_snp"), outcome.alias("outcome"))


def call_rates(outcomes: DataFrame, by: str = "callset", least_quality: int = 20) -> DataFrame:
    """For each call set: totals of TP and FP, those of enough quality, FN that are SNPs, precision and recall."""
    fine = F.coalesce(F.col("qual") >= least_quality, F.lit(False))
    o = F.col("outcome")
    n = outcomes.groupBy(by).agg(
        F.count_if((o == "TP") & fine).alias("tp20"),
        F.count_if((o == "FP") & fine).alias("fp20"),
        F.count_if(o == "TP").alias("tp"),
        F.count_if(o == "FP").alias("fp"),
        F.count_if((o == "FN") & F.coalesce("is_snp", F.lit(False))).alias("fn"),
    )
    return n.withColumn("precision", F.col("tp20") / F.nullif(F.col("tp20") + F.col("fp20"), F.lit(0))).withColumn("recall", F.col("tp20") / F.nullif(F.col("tp20") + F.col("fn"), F.lit(0)))


def percent_change(before: Column, after: Column) -> Column:
    return (after / F.nullif(before, F.lit(0.0)) - 1) * 100


def stats_row(rates: DataFrame, before: str = "nocal", after: str = "recal", by: str = "callset") -> DataFrame:
    """One row: five counts before and after, precision and recall before and after, and their changes in percent."""
    counts = ["tp20", "fp20", "tp", "fp", "fn"]

    def of(which: str, c: str) -> Column:
        return F.max(F.when(F.col(by) == which, F.col(c)))

    one = rates.agg(
        *[of(w, c).alias(f"{c}_{n}") for n, w in (("before", before), ("after", after)) for c in counts],
        *[of(w, c).alias(f"{c}_{n}") for n, w in (("before", before), ("after", after)) for c in ("precision", "recall")],
    )
    return one.withColumn("precision_change", percent_change(F.col("precision_before"), F.col("precision_after"))).withColumn("recall_change", percent_change(F.col("recall_before"), F.col("recall_after")))
