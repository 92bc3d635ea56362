"""Down-sampled replicates carried through recalibration, calls and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.operators.features import usable
from quillmap.operators.intervals import allele_counts, variable_positions
from quillmap.operators.recalibrate import last_scores
from quillmap.operators.sampling import replicates
from quillmap.operators.variants import percent_change

RUN = ("replicate", "stage")


def replicate_sites(reads: DataFrame, scores: DataFrame, seeds: list[int], share: float, least_mapq: int = 20, least_reads: int = 1) -> DataFrame:
    """``replicate``, ``stage`` (before, after), ``contig_idx`` and ``pos`` of the variable positions of each down-sample.

    Each read joins its new score once; then it goes to the replicates that drew its name, and there to the pile-up before or after
    recalibration, or both, where its mapping quality is high enough. Bases combine before the shuffle. Reads without a
    mapping quality are in no pile-up; multi-mappers and unmapped reads are left out.
    """
    own = usable(reads).select("read_name", "qname", "contig_idx", "begin_pos", "is_unmapped", "seq", "qual", "mapq")
    own = own.join(last_scores(scores), "read_name", "left")
    stages = F.array_compact(F.array(F.when(F.col("mapq") >= least_mapq, F.lit("before")), F.when(F.coalesce("mapq_new", "mapq") >= least_mapq, F.lit("after"))))
    staged = replicates(own, seeds, share).withColumn("stage", F.explode(stages))
    return variable_positions(allele_counts(staged, by=RUN), least_reads, by=RUN).select(*RUN, "contig_idx", "pos")


def replicate_rates(sites: DataFrame, truth: DataFrame, seeds: list[int]) -> DataFrame:
    """One row for each replicate: true and false positives and misses against ``truth`` (``contig_idx``, ``pos``), precision and recall
    before and after, and their changes in percent. A replicate without any site has only misses."""
    known = truth.where("contig_idx IS NOT NULL AND pos IS NOT NULL").select("contig_idx", "pos").distinct()
    met = sites.join(known.withColumn("_known", F.lit(True)), ["contig_idx", "pos"], "left")
    n = met.groupBy("replicate").agg(*[F.count_if((F.col("stage") == s) & (F.col("_known").isNotNull() == hit)).alias(f"{c}_{s}") for s in ("before", "after") for c, hit in (("tp", True), ("fp", False))])
    all_ = sites.sparkSession.createDataFrame([(s,) for s in seeds], "replicate int").join(n, "replicate", "left").crossJoin(F.broadcast(known.agg(F.count(F.lit(1)).alias("_truth"))))
    for s in ("before", "after"):
        tp, fp = F.coalesce(f"tp_{s}", F.lit(0)), F.coalesce(f"fp_{s}", F.lit(0))
        all_ = all_.withColumns({f"tp_{s}": tp, f"fp_{s}": fp}).withColumns(
            {f"fn_{s}": F.col("_truth") - F.col(f"tp_{s}"), f"precision_{s}": F.col(f"tp_{s}") / F.nullif(F.col(f"tp_{s}") + F.col(f"fp_{s}"), F.lit(0)), f"recall_{s}": F.col(f"tp_{s}") / F.nullif("_truth", F.lit(0))}
        )
    return all_.drop("_truth").withColumns({f"{c}_change": percent_change(F.col(f"{c}_before"), F.col(f"{c}_after")) for c in ("precision", "recall")})
