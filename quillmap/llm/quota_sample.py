"""Problem 4: samples that match target shares of categories, with a minimum for small ones and a report of what can't be met.

Acceptance probabilities come from target-to-observed ratios; reads are accepted independently with slight oversampling, and
the counts are then corrected exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.names import cleaned, read_key
from quillmap.operators.exact_take import random_key, take_smallest, uniform
from quillmap.operators.skew import hot_buckets, salted_join
from quillmap.session import cut

GROUP = ["draw_id", "class_code"]


def last_classes(rows: DataFrame, row_id: str = "feat_id") -> DataFrame:
    """``run``, ``read_key``, row id and ``class_code`` of each read of each run: its last arrived row (then the highest row id).

    Null, NaN and other classes than whole numbers become null: such a read is available to no class.
    """
    last = F.max_by(F.struct(row_id, "class_code"), F.struct("arrived_at", row_id)).alias("_v")
    code = F.when(F.col("_v.class_code") == F.floor("_v.class_code"), F.col("_v.class_code").try_cast("int"))
    return (
        rows.groupBy(cleaned(F.col("run_id")).alias("run"), read_key(F.col("read_name"), F.col(row_id)).alias("read_key"))
        .agg(last)
        .select("run", "read_key", f"_v.{row_id}", code.alias("class_code"))
    )


def targets(draws: DataFrame) -> DataFrame:
    """``draw_id``, ``run``, ``class_code`` and ``target``, the greater of the floor and the rounded share of the draw.

    A missing share, floor or size counts as 0; repeated entries of a draw's class count once, with the greatest target; entries
    without a draw or a class count for nothing.
    """
    share = F.round(F.coalesce(F.nanvl("share", F.lit(0.0)), F.lit(0.0)) * F.coalesce("draw_size", F.lit(0))).cast("bigint")
    return (
        draws.where("draw_id IS NOT NULL AND class_code IS NOT NULL")
        .select(*GROUP, cleaned(F.col("run_id")).alias("run"), F.greatest(share, F.coalesce("floor_rows", F.lit(0)).cast("bigint")).alias("target"))
        .groupBy(*GROUP, "run")
        .agg(F.max("target").alias("target"))
    )


def quota_plan(reads: DataFrame, draws: DataFrame, oversampling: float = 0.05) -> DataFrame:
    """For each draw and class: ``target``, ``available`` reads and ``accept``, the probability of acceptance.

    ``accept`` is the ratio of target to observed reads, raised by ``oversampling`` and four standard deviations, so that a
    shortfall after independent acceptance is rare; :func:`quota_sample` makes up for one all the same.
    """
    seen = reads.where("class_code IS NOT NULL AND run IS NOT NULL").groupBy("run", "class_code").agg(F.count(F.lit(1)).alias("available"))
    plan = targets(draws).join(seen, ["run", "class_code"], "left").withColumn("available", F.coalesce("available", F.lit(0)))
    raised = F.col("target") * (1 + oversampling) + 4 * F.sqrt(F.col("target").cast("double")) + 4
    accept = F.when(F.col("available") > 0, F.least(F.lit(1.0), raised / F.col("available"))).otherwise(0.0)
    return plan.withColumn("accept", F.when(F.col("target") > 0, accept).otherwise(0.0))


def accepted(reads: DataFrame, plan: DataFrame, row_id: str, seed: int) -> DataFrame:
    """Reads accepted independently by each draw, with their random key."""
    at = F.concat_ws("|", "class_code", "run").alias("_at")
    wanted = plan.where("accept > 0").select(at, *GROUP, "accept")
    own = reads.where("class_code IS NOT NULL AND run IS NOT NULL").select(row_id, "read_key", at)
    # reads meet the draws of their run one by one and most pairs end in the filter below: nothing is gathered by run
    got = salted_join(own, wanted, "_at", "inner", hot_buckets(own, "_at"))
    got = got.select(row_id, *GROUP, "accept", random_key(seed, F.col("draw_id"), F.col("read_key")).alias("_key"))
    return got.where(uniform(F.col("_key")) < F.col("accept")).drop("accept")


def quota_sample(rows: DataFrame, draws: DataFrame, row_id: str = "feat_id", seed: int = 5, oversampling: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The sample (``draw_id``, ``class_code``, row id) and its report: :func:`quota_plan` with ``drawn``, counted in the
    sample as it came out, and ``deficit``, how far that stays below the target.

    Each class of a draw gets exactly its target, or all available reads and a deficit in the report. Null, NaN or unknown
    classes are never drawn. A draw of an unknown run, or an empty table, has nothing but deficits.
    """
    reads = cut(last_classes(rows, row_id))
    plan = cut(quota_plan(reads, draws, oversampling))
    first = cut(accepted(reads, plan, row_id, seed))
    counts = first.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("_n"))
    short = plan.join(counts, GROUP, "left").where(F.coalesce("_n", F.lit(0)) < F.least("target", "available")).drop("_n")
    if not short.isEmpty():
        # independent acceptance fell short of a target: the classes concerned accept everything
        again = accepted(reads, short.withColumn("accept", F.lit(1.0)), row_id, seed)
        first = first.join(short.select(*GROUP), GROUP, "left_anti").unionByName(again)
    sample = take_smallest(first, GROUP, "_key", row_id, plan.select(*GROUP, F.col("target").alias("quota")))
    drawn = sample.groupBy(*GROUP).agg(F.count(F.lit(1)).alias("drawn"))
    report = plan.drop("accept").join(drawn, GROUP, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    report = report.withColumn("deficit", F.greatest(F.lit(0), F.col("target") - F.col("drawn")))
    return sample.select(*GROUP, row_id), report
