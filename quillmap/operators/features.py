"""The feature vector of aligned reads, its filters, counters and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmap.functions import reads as R
from quillmap.functions import sequences as S
from quillmap.operators.intervals import reference_pieces, reference_windows, with_depth
from quillmap.sources.schemas import FEATURE_FILE

LAGGED = ["n_low_qual_bases", "avg_low_qual_base_score"]


def usable(reads: DataFrame) -> DataFrame:
    """Mapped reads with a best place: unmapped reads and multi-mappers are dropped."""
    return reads.where(R.mapped() & ~R.multi_mapped())


def feature_vector(reads: DataFrame, names: list[str] | None = None, keep: tuple[str, ...] = ("ord", "read_name")) -> DataFrame:
    """One projection over the usable reads; only the columns that the chosen features need are scanned."""
    return usable(reads).select(*keep, *[R.FEATURES[n]().alias(n) for n in names or R.FEATURES])


def lagged_features(reads: DataFrame) -> DataFrame:
    """The low-quality features as an older writing order had them: each read has those of the read before it on its contig, the first has 0.

    The order is (begin_pos, ord), that of a sorted file. Windows run within stretches of a contig and the last row before
    each stretch is brought in by a join, so no task sorts a whole contig.
    """
    rows = usable(reads).select("ord", "contig_idx", "begin_pos", *[R.FEATURES[n]().alias(n) for n in LAGGED])
    rows = rows.withColumn("_stretch", F.floor(F.col("begin_pos") / 100_000))
    place = Window.partitionBy("contig_idx", "_stretch").orderBy("begin_pos", "ord")
    last = rows.groupBy("contig_idx", "_stretch").agg(F.max_by(F.struct(*LAGGED), F.struct("begin_pos", "ord")).alias("_last"))
    before = last.withColumn("_before", F.lag("_last").over(Window.partitionBy("contig_idx").orderBy("_stretch"))).drop("_last")
    own = rows.withColumn("_own", F.lag(F.struct(*LAGGED)).over(place)).join(before, ["contig_idx", "_stretch"])
    pick = F.coalesce("_own", "_before")
    return own.select("ord", "contig_idx", *[F.coalesce(pick[n], F.lit(0)).alias(n) for n in LAGGED])


def sequence_features(reads: DataFrame) -> DataFrame:
    """Features of sequence and quality strings: GC content, regression line, complexity and invariants."""
    rows = usable(reads).select(
        "ord",
        S.gc_content(F.col("seq")).alias("read_gc_content"),
        S.quality_line("qual").alias("line"),
        S.zlib_length(6)("seq").alias("read_complexity_score"),
        S.sequence_invariants("seq").alias("inv"),
    )
    named = [F.col(f"line.{a}").alias(f"qual_{b}") for a, b in (("intercept", "intercept"), ("slope", "slope"), ("r", "r_value"))]
    inv = [F.col(f"inv.{a}").alias(f"read_{a}") for a in ("eigenval_1", "eigenval_2", "trace", "det")]
    return rows.select("ord", "read_gc_content", "read_complexity_score", *named, *inv)


def full_vector(reads: DataFrame, contigs: DataFrame | None = None, genome: DataFrame | None = None, chunk: int = 1 << 20) -> DataFrame:
    """``ord``, ``read_name`` and the 33 columns of the feature file for every usable read; those of the reference are 0 without a genome.

    What comes from a read itself is one projection; depth and reference window are joined to it. Invariants and slopes that
    aren't defined are 0, as the file has no null.
    """
    own = usable(reads).select(
        "ord", "read_name", *[R.FEATURES[n]().alias(n) for n in R.FEATURES],
        F.coalesce(S.gc_content(F.col("seq")), F.lit(0.0)).alias("read_gc_content"), S.quality_line("qual").alias("_line"), S.zlib_length(6)("seq").alias("read_complexity_score"),
        S.sequence_invariants("seq").alias("_inv"),
    )
    named = {"qual_intercept": "_line.intercept", "qual_slope": "_line.slope", "qual_r_value": "_line.r", **{f"read_{a}": f"_inv.{a}" for a in ("eigenval_1", "eigenval_2", "trace", "det")}}
    own = own.withColumns({a: F.col(b) for a, b in named.items()}).drop("_line", "_inv")
    out = own.join(with_depth(usable(reads)).withColumnRenamed("depth", "read_depth"), "ord", "left")
    if genome is not None:
        out = out.join(reference_features(reads, contigs, genome, chunk), "ord", "left")
    return out.select("ord", "read_name", *[(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in out.columns else F.lit(0.0)).alias(c) for c in FEATURE_FILE])


def reference_features(reads: DataFrame, contigs: DataFrame, genome: DataFrame, chunk: int, margin: int = 125) -> DataFrame:
    """GC content, complexity and invariants of each read's reference window."""
    pieces = reference_pieces(reference_windows(usable(reads), contigs, margin), genome, chunk)
    rows = pieces.select("ord", S.gc_content(F.col("piece")).alias("ref_gc_content"), S.zlib_length(6)("piece").alias("ref_complexity_score"), S.sequence_invariants("piece").alias("inv"))
    return rows.select("ord", "ref_gc_content", "ref_complexity_score", *[F.col(f"inv.{a}").alias(f"ref_{a}") for a in ("eigenval_1", "eigenval_2", "trace", "det")])


def region_counts(reads: DataFrame, size: int = 1_000_000) -> DataFrame:
    """Placed reads by contig and region of ``size`` bases: the units that callers work through side by side."""
    rows = reads.where(R.mapped())
    return rows.groupBy("contig_idx", F.floor(F.col("begin_pos") / size).alias("region")).agg(F.count(F.lit(1)).alias("reads"))


def labelled(reads: DataFrame) -> DataFrame:
    return usable(reads).withColumn("label", R.misplaced_label())


def read_counters(reads: DataFrame) -> DataFrame:
    """Counts of one pass: reads, unmapped, multi-mapped, misaligned and well aligned."""
    best = R.mapped() & ~R.multi_mapped()
    return reads.agg(
        F.count(F.lit(1)).alias("reads"),
        F.count_if(~R.mapped()).alias("unmapped"),
        F.count_if(R.mapped() & R.multi_mapped()).alias("multi_mapped"),
        F.count_if(best & (R.misplaced_label() == 1)).alias("misaligned"),
        F.count_if(best & (R.misplaced_label() == 0)).alias("well_aligned"),
    )


def bad_read_ratio(reads: DataFrame) -> DataFrame:
    """Misaligned over well aligned reads; null without well aligned ones."""
    n = read_counters(reads)
    return n.select((F.col("misaligned") / F.nullif("well_aligned", F.lit(0))).alias("ratio"))


def mapq_histogram(reads: DataFrame, factor: float = 1.0) -> DataFrame:
    """Share of each MAPQ among well aligned reads, times ``factor``."""
    per = labelled(reads).where("label = 0").groupBy("mapq").agg(F.count(F.lit(1)).alias("n"))
    total = per.agg(F.sum("n").alias("total"))
    return per.crossJoin(F.broadcast(total)).select("mapq", (F.col("n") / F.col("total") * factor).alias("probability"))
