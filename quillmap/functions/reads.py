"""Alignment records: filters, features and origin labels as Column expressions.

Missing tags have the defaults of the data model: AS 0, XS 75, YS 0 and 0 for the counts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phred score below which a base counts as of low quality; quality strings are phred + 33.
LOW_QUALITY = 20
XS_DEFAULT = 75
#: Mean score reported where a read has no base of low quality.
NO_LOW_QUALITY = 40.0


def c(name: str) -> Column:
    return F.col(name)


def alignment_score() -> Column:
    return F.coalesce(c("as_"), F.lit(0))


def secondary_score() -> Column:
    return F.coalesce(c("xs"), F.lit(XS_DEFAULT))


def multi_mapped() -> Column:
    """Best and second-best alignment score are equal after defaults."""
    return alignment_score() == secondary_score()


def mapped() -> Column:
    return ~F.coalesce(c("is_unmapped"), F.lit(False)) & c("contig_idx").isNotNull()


def insert_sign() -> Column:
    return F.signum(F.coalesce(c("tlen"), F.lit(0)).cast("double")).cast("int")


def pair_orientation() -> Column:
    """F1R2 0, F1F2 1, R1R2 2, R1F2 3."""
    return (
        F.when(~c("is_rc") & c("mate_rc"), 0).when(~c("is_rc") & ~c("mate_rc"), 1).when(c("is_rc") & c("mate_rc"), 2).when(c("is_rc") & ~c("mate_rc"), 3)
    )


def pair_alignment_type() -> Column:
    """CP or missing 0, DP 1, UP 2, UU 3; other codes are null."""
    return F.when(c("yt").isNull() | (c("yt") == "CP"), 0).when(c("yt") == "DP", 1).when(c("yt") == "UP", 2).when(c("yt") == "UU", 3)


def _low_bases() -> Column:
    # '4' is phred 19: what is left are the characters of low-quality bases
    return F.regexp_replace(F.coalesce(c("qual"), F.lit("")), "[^!-4]", "")


def low_quality_count() -> Column:
    return F.length(_low_bases())


def low_quality_mean() -> Column:
    total = F.aggregate(F.split(_low_bases(), ""), F.lit(0), lambda s, b: s + F.ascii(b) - 33)
    n = low_quality_count()
    return F.when(n > 0, total / n).otherwise(F.lit(NO_LOW_QUALITY))


def origins(qname: Column) -> Column:
    """Simulated locations of both mates in a name ``chrom-pos-strand,..:chrom-pos-strand,..::serial``."""
    fields = F.slice(F.split(qname, ":"), 1, 2)
    places = F.filter(F.flatten(F.transform(fields, lambda f: F.split(f, ","))), lambda p: p != "")
    parts = F.transform(places, lambda p: F.split(p, "-"))
    placed = F.transform(parts, lambda p: F.struct(F.lower(F.get(p, 0)).alias("chrom"), F.get(p, 1).try_cast("int").alias("pos")))
    return F.filter(placed, lambda p: p["pos"].isNotNull())


def well_placed(tolerance: int = 1) -> Column:
    """Whether either mate's origin lies on the read's contig within ``tolerance`` bases of its begin; null if the name has no origin."""
    at = origins(c("qname"))
    near = F.exists(at, lambda p: (p["chrom"] == F.lower(c("contig"))) & (F.abs(p["pos"] - c("begin_pos")) <= tolerance))
    return F.when(F.size(at) > 0, F.coalesce(near, F.lit(False)))


def misplaced_label() -> Column:
    """1 for a misaligned read, 0 for a good one, null if its origin is unknown."""
    return (~well_placed()).cast("int")


#: The feature vector in its order: name and expression.
FEATURES: dict[str, object] = {
    "chromosome_idx": lambda: c("contig_idx"),
    "read_begin_pos": lambda: c("begin_pos") + 1,
    "mapq": lambda: c("mapq"),
    "insert_size": insert_sign,
    "gap_extensions": lambda: F.coalesce(c("xg"), F.lit(0)),
    "edit_distance": lambda: F.coalesce(c("nm"), F.lit(0)),
    "mismatches": lambda: F.coalesce(c("xm"), F.lit(0)),
    "gap_opens": lambda: F.coalesce(c("xo"), F.lit(0)),
    "alignment_score": alignment_score,
    "secondary_alignment_score": secondary_score,
    "pair_orientation": pair_orientation,
    "pair_alignment_type": pair_alignment_type,
    "n_low_qual_bases": low_quality_count,
    "avg_low_qual_base_score": low_quality_mean,
    "mate_alignment_score": lambda: F.coalesce(c("ys"), F.lit(0)),
    "alignment_scores_diff": lambda: secondary_score() - alignment_score(),
    "class_code": misplaced_label,
}


def phred(p: Column) -> Column:
    """Truncated phred score of a probability; below 1e-8 it counts as 1e-5. Base 10 as a quotient of natural logarithms."""
    safe = F.when(p < 1e-8, F.lit(1e-5)).otherwise(p)
    return F.when((p >= 0) & (p <= 1), (F.lit(-10.0) * F.ln(safe) / F.ln(F.lit(10.0))).cast("int"))


def curve_phred(q: Column) -> Column:
    """Probability of a phred score as calibration curves take it: a score of 0 counts as 1e-5, so its probability is nearly 1."""
    return F.pow(F.lit(10.0), -F.when(q == 0, F.lit(1e-5)).otherwise(q) / 10.0)


def inverse_phred(q: Column) -> Column:
    """Probability of a phred score; a score of 0 gives 1e-6."""
    return F.when(q == 0, F.lit(1e-6)).otherwise(F.pow(F.lit(10.0), -q / 10.0))
