"""Metrics of MAPQ as a predictor of misalignment, over the feature table; and intervals over the reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import reads as R
from quillmap.ml import calibrate
from quillmap.operators import intervals, metrics
from quillmap.sources.tables import table

MAPQ = "CASE WHEN NOT isnan(mapq) THEN mapq END"


def scored(spark, d):
    """Rows of a known class, with the error probability that their MAPQ states as score and a prediction at 0.05."""
    f = table(spark, d, "feats").where("class_code IN (0, 1) AND mapq IS NOT NULL AND NOT isnan(mapq)")
    score = R.inverse_phred(F.col("mapq"))
    return f.select("feat_id", F.col("class_code").cast("int").alias("label"), F.col("mapq").cast("int").alias("mapq"), score.alias("score"), (score > 0.05).cast("int").alias("predicted"))


SCORED = """s AS (SELECT feat_id, CAST(class_code AS INTEGER) AS label, CAST(mapq AS INTEGER) AS mapq, CASE WHEN mapq = 0 THEN 1e-6 ELSE pow(10, -mapq / 10) END AS score FROM feats
  WHERE class_code IN (0, 1) AND mapq IS NOT NULL AND NOT isnan(mapq)), p AS (SELECT *, CAST(score > 0.05 AS INTEGER) AS predicted FROM s)"""
CELLS = f"""WITH {SCORED}, c AS (SELECT count(*) FILTER (label = 0 AND predicted = 0) AS tn, count(*) FILTER (label = 0 AND predicted = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted = 0) AS fn, count(*) FILTER (label = 1 AND predicted = 1) AS tp FROM p)"""
PILEUP = """a AS (SELECT contig_idx, begin_pos, seq, qual, unnest(range(1, least(length(seq), length(qual)) + 1)) AS i FROM reads WHERE contig_idx IS NOT NULL AND NOT coalesce(is_unmapped, false)),
  c AS (SELECT contig_idx, CAST(begin_pos + i - 1 AS INTEGER) AS pos, upper(substr(seq, i, 1)) AS base, count(*) AS n FROM a WHERE ascii(substr(qual, i, 1)) - 33 >= 5 GROUP BY ALL)"""
SCALED = ["alignment_score", "edit_distance", "read_gc_content"]


def calibrated(spark, d):
    return calibrate.isotonic_table(scored(spark, d), "label", "mapq")


QUERIES = {
    "confusion": (lambda s, d: metrics.confusion(scored(s, d)), f"{CELLS} SELECT * FROM c"),
    "prf": (
        lambda s, d: metrics.rates(metrics.confusion(scored(s, d))),
        f"""{CELLS}, x AS (SELECT tp::DOUBLE / nullif(tp + fp, 0) AS precision_1, tp::DOUBLE / nullif(tp + fn, 0) AS recall_1, 2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0) AS f1_1,
        tn::DOUBLE / nullif(tn + fn, 0) AS precision_0, tn::DOUBLE / nullif(tn + fp, 0) AS recall_0, 2.0::DOUBLE * tn / nullif(2 * tn + fp + fn, 0) AS f1_0,
        (tp + tn)::DOUBLE / nullif(tp + tn + fp + fn, 0) AS accuracy, tn + fp AS n0, tp + fn AS n1 FROM c)
        SELECT precision_1, recall_1, f1_1, precision_0, recall_0, f1_0, accuracy, sqrt(recall_1 * recall_0) AS gmean,
        sqrt((recall_1 * n1 + recall_0 * n0) / (n0 + n1) * (recall_0 * n1 + recall_1 * n0) / (n0 + n1)) AS gmean_weighted,
        (coalesce(f1_1, 0) * n1 + coalesce(f1_0, 0) * n0) / nullif(n0 + n1, 0) AS f1_weighted FROM x""",
    ),
    "brier": (lambda s, d: metrics.brier(scored(s, d)), f"WITH {SCORED} SELECT avg((score - label) * (score - label)) AS brier FROM p"),
    "average_precision": (
        lambda s, d: metrics.average_precision(scored(s, d)),
        f"""WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(label) AS tp FROM p GROUP BY score),
        w AS (SELECT tp, sum(n) OVER (ORDER BY score DESC) AS seen, sum(tp) OVER (ORDER BY score DESC) AS hits, sum(tp) OVER () AS positives FROM g)
        SELECT sum(tp::DOUBLE / nullif(positives, 0) * hits / seen) AS average_precision FROM w""",
    ),
    "calibration_curve": (
        lambda s, d: metrics.calibration_curve(scored(s, d)),
        f"WITH {SCORED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, avg(score) AS mean_score, avg(label) AS positives, count(*) AS n FROM p GROUP BY 1",
    ),
    "prob_histogram": (
        lambda s, d: metrics.score_histogram(scored(s, d)),
        f"WITH {SCORED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n FROM p GROUP BY 1",
    ),
    "class_counts": (
        lambda s, d: metrics.class_counts(table(s, d, "feats").withColumn("class_code", F.when(~F.isnan("class_code"), F.col("class_code")).cast("int")), "class_code"),
        "SELECT CAST(trunc(CASE WHEN NOT isnan(class_code) THEN class_code END) AS INTEGER) AS class_code, count(*) AS n FROM feats GROUP BY 1",
    ),
    "minmax_scale": (
        lambda s, d: metrics.minmax_scaled(table(s, d, "feats"), SCALED, ("feat_id",)),
        "WITH "
        + "f AS (SELECT feat_id, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in SCALED) + " FROM feats) "
        + "SELECT feat_id, " + ", ".join(f"({c} - min({c}) OVER ()) / nullif(max({c}) OVER () - min({c}) OVER (), 0) AS {c}" for c in SCALED) + " FROM f",
    ),
    "phred_score": (
        lambda s, d: scored(s, d).select("feat_id", R.phred(F.col("score")).alias("phred")),
        f"WITH {SCORED} SELECT feat_id, CAST(trunc(-10 * ln(CASE WHEN score < 1e-8 THEN 1e-5 ELSE score END) / ln(10)) AS INTEGER) AS phred FROM p",
    ),
    "inverse_phred": (
        lambda s, d: table(s, d, "reads").groupBy("mapq").agg(F.count(F.lit(1)).alias("n")).select("mapq", R.inverse_phred(F.col("mapq")).alias("p"), R.curve_phred(F.col("mapq")).alias("p_curve"), "n"),
        """SELECT mapq, CASE WHEN mapq = 0 THEN 1e-6 ELSE pow(10, -mapq / 10.0) END AS p, pow(10, -CASE WHEN mapq = 0 THEN 1e-5 ELSE mapq END / 10.0) AS p_curve, count(*) AS n
        FROM reads GROUP BY mapq""",
    ),
    "isotonic_calibration": (
        calibrated,
        f"""WITH {SCORED}, g AS (SELECT -mapq AS x, sum(label) AS y, count(*) AS n FROM p GROUP BY mapq),
        m AS (SELECT a.x AS lo, b.x AS hi, (SELECT sum(y)::DOUBLE / sum(n) FROM g WHERE g.x BETWEEN a.x AND b.x) AS mean FROM g a JOIN g b ON a.x <= b.x),
        f AS (SELECT g.x, m.lo, min(m.mean) AS least FROM g JOIN m ON m.lo <= g.x AND m.hi >= g.x GROUP BY g.x, m.lo)
        SELECT CAST(-x AS INTEGER) AS mapq, max(least) AS probability FROM f GROUP BY x""",
    ),
    "read_depth": (
        lambda s, d: intervals.with_depth(table(s, d, "reads")),
        """WITH r AS (SELECT ord, contig_idx, begin_pos AS b, begin_pos + length(seq) AS e, begin_pos + length(seq) // 2 AS m FROM reads WHERE contig_idx IS NOT NULL)
        SELECT q.ord, count(*) AS depth FROM r q JOIN r ON r.contig_idx = q.contig_idx AND r.b < q.m + 10 AND r.e > q.m - 10 GROUP BY q.ord""",
    ),
    "ref_window": (
        lambda s, d: intervals.reference_windows(table(s, d, "reads"), table(s, d, "contigs")),
        """SELECT ord, contig_idx, greatest(begin_pos - 125, 0) AS "left", CAST(least(begin_pos + length(seq) + 125, c.length) AS INTEGER) AS "right"
        FROM reads JOIN contigs c USING (contig_idx) WHERE least(begin_pos + length(seq) + 125, c.length) > greatest(begin_pos - 125, 0)""",
    ),
    "pileup_counts": (
        lambda s, d: intervals.allele_counts(table(s, d, "reads")),
        f"WITH {PILEUP} SELECT * FROM c",
    ),
    "pileup_calls": (
        lambda s, d: intervals.variable_positions(intervals.allele_counts(table(s, d, "reads")), least_reads=1),
        f"""WITH {PILEUP}, b AS (SELECT contig_idx, pos, base, n, row_number() OVER w AS r, sum(n) OVER (PARTITION BY contig_idx, pos) AS depth FROM c WHERE base <> 'N'
          WINDOW w AS (PARTITION BY contig_idx, pos ORDER BY n DESC, base DESC))
        SELECT x.contig_idx, x.pos, CAST(x.depth AS BIGINT) AS depth, x.base AS major, y.base AS minor, y.n AS minor_n FROM b x JOIN b y ON x.contig_idx = y.contig_idx AND x.pos = y.pos
        WHERE x.r = 1 AND y.r = 2 AND y.n >= 1 AND y.n >= x.depth * 0.2""",
    ),
}
