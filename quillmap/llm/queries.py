"""Queries of the numbered problems tagged llm: name, Spark callable and, where SQL can say the same, the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.names import template
from quillmap.llm import abuse, fixed_sample, mixture, neighbors, quota_sample, splits, tokens
from quillmap.session import cut
from quillmap.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.related_groups(table(spark, d, "feats"), table(spark, d, "template_alias"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_rows(table(spark, d, "feats"), table(spark, d, "template_alias"), table(spark, d, "split_share"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: rows with a split, tied groups and templates in more than one split, and whether every share of rows is within 0.05 of its target."""
    feats, alias, shares = table(spark, d, "feats"), table(spark, d, "template_alias"), table(spark, d, "split_share")
    split = cut(splits.split_rows(feats, alias, shares))
    groups = splits.related_groups(feats, alias).join(split, "feat_id").groupBy("group_id").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"))
    names = feats.select("feat_id", template(F.col("read_name")).alias("t")).where("t IS NOT NULL").join(split, "feat_id").groupBy("t").agg(F.min("split_name").alias("a"), F.max("split_name").alias("b"))
    total = split.groupBy("split_name").agg(F.count(F.lit(1)).alias("n"))
    near = shares.join(total, "split_name", "left").crossJoin(F.broadcast(total.agg(F.sum("n").alias("all")))).agg(F.every(F.abs(F.coalesce("n", F.lit(0)) / F.col("all") - F.col("share")) < 0.05).alias("near"))
    broken = groups.agg(F.count_if(F.col("a") != F.col("b")).alias("broken_groups")).crossJoin(names.agg(F.count_if(F.col("a") != F.col("b")).alias("broken_templates")))
    return split.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("feat_id").alias("n_ids")).crossJoin(broken).crossJoin(near)


def p2_positions(spark: SparkSession, d: str) -> DataFrame:
    """Every read with its number, its place in the permutation and whether that puts it into the sample of 1,000."""
    rows = fixed_sample.shuffled(table(spark, d, "feats"), ["mapq", "alignment_score"])
    return rows.withColumn("sampled", F.col("position") < 1000)


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """One row: how many reads, numbers and positions there are, their ends, and the reads in the sample."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("number", "position") for n, f in (("n", F.count_distinct), ("least", F.min), ("most", F.max))]
    return p2_positions(spark, d).agg(F.count_distinct("read_key").alias("n_reads"), *ends, F.count_if("sampled").alias("n_sampled"))


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return fixed_sample.fixed_sample(table(spark, d, "feats"), ["mapq", "alignment_score"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = neighbors.similar_rows(table(spark, d, "feats"), table(spark, d, "featscale"), table(spark, d, "vec_probe"))
    return pairs.select(F.least("query", "id").alias("feat_a"), F.greatest("query", "id").alias("feat_b")).distinct()


def p3_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """Queries: every row whose id is divisible by 20, against all rows."""
    return neighbors.similar_rows(table(spark, d, "feats"), table(spark, d, "featscale"), wanted=F.col("feat_id") % 20 == 0)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota_sample.quota_sample(table(spark, d, "feats"), table(spark, d, "draw_target"))
    return report.where("deficit > 0").select("draw_id", "class_code")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    _, report = quota_sample.quota_sample(table(spark, d, "feats"), table(spark, d, "draw_target"))
    return report.select("draw_id", "class_code", "run", "target", "available", "deficit", "drawn")


def p4_sample(spark: SparkSession, d: str) -> DataFrame:
    return quota_sample.quota_sample(table(spark, d, "feats"), table(spark, d, "draw_target"))[0]


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p6_texts(spark: SparkSession, d: str) -> DataFrame:
    """The digest of each document's text as it comes back from its ids."""
    return tokens.token_texts(tokens.token_ids(table(spark, d, "documents"))).select("doc_id", F.md5("text").alias("text_md5"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))
    return report.where("unmet").select("source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.mixture(table(spark, d, "documents"), table(spark, d, "mix_target"))[1]


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """For each source, whether the mix keeps its budget and its repeats, has used all repeats or has no room for even the shortest document
    that could come once more, and whether each of its documents is in the mix as often as any other or once more."""
    docs = table(spark, d, "documents")
    mix, report = mixture.mixture(docs, table(spark, d, "mix_target"))
    sizes = mixture.sized_documents(docs).where("tokens > 0").join(report.select("source", "whole", "max_repeats"), "source")
    every = sizes.join(mix.select("doc_id", "copies"), "doc_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
    again = F.min(F.when((F.col("copies") <= F.col("whole")) & (F.col("copies") < F.col("max_repeats")), F.col("tokens"))).alias("_again")
    by = every.groupBy("source").agg(again, F.max("copies").alias("_most"), F.min("copies").alias("_least"))
    return report.join(by, "source", "left").select(
        "source",
        "max_repeats",
        (F.col("mixed") <= F.col("budget")).alias("within_budget"),
        (F.coalesce("_most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"),
        (F.col("unmet") | F.coalesce(F.col("mixed") + F.col("_again") > F.col("budget"), F.col("mixed") == F.floor("budget"))).alias("budget_met"),
        (F.coalesce(F.col("_most") - F.col("_least"), F.lit(0)) <= 1).alias("even_copies"),
    )


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.flagged(abuse.content_scores(table(spark, d, "documents"))).select("doc_id")


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.content_scores(table(spark, d, "documents")).select("doc_id", "score")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.source_rates(abuse.content_scores(table(spark, d, "documents")))


_CLEAN = r"regexp_replace(lower({c}), '^\s+|\s+$', '', 'g')"
_STEM = r"coalesce(nullif(regexp_extract({x}, '^(.*?::\d+)', 1), ''), nullif({x}, ''))"


def _template(column: str) -> str:
    return _STEM.format(x=_CLEAN.format(c=column))


P1_SQL = rf"""
WITH RECURSIVE e AS (
  SELECT {_template("name_a")} AS a, {_template("name_b")} AS b FROM template_alias),
g AS (SELECT a, b FROM e WHERE a IS NOT NULL AND b IS NOT NULL UNION SELECT b, a FROM e WHERE a IS NOT NULL AND b IS NOT NULL),
r AS (SELECT a AS node, a AS seen FROM g UNION SELECT r.node, g.b FROM r JOIN g ON r.seen = g.a),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
f AS (SELECT feat_id, {_template("read_name")} AS t FROM feats),
x AS (SELECT feat_id, t, component FROM f JOIN c ON f.t = c.node),
m AS (SELECT component, min(feat_id) AS group_id FROM x GROUP BY component HAVING count(DISTINCT t) > 1)
SELECT group_id, feat_id FROM x JOIN m USING (component)
"""

_P4 = rf"""
WITH f AS (
  SELECT {_CLEAN.format(c="run_id")} AS run, feat_id, class_code, arrived_at, {_CLEAN.format(c="read_name")} AS n FROM feats),
k AS (SELECT *, coalesce({_STEM.format(x="n")} || '|' || regexp_extract(n, '::\d+\D*([12])', 1), 'row ' || feat_id) AS read_key FROM f),
l AS (SELECT run, read_key, arg_max(CASE WHEN class_code IS NULL THEN -9 ELSE class_code END, (arrived_at, feat_id)) AS class_code
      FROM k GROUP BY ALL),
s AS (SELECT run, class_code, count(*) AS available FROM l GROUP BY ALL),
t AS (SELECT draw_id, class_code, {_CLEAN.format(c="run_id")} AS run,
             greatest(CAST(round(share * draw_size) AS BIGINT), floor_rows) AS target FROM draw_target),
p AS (SELECT t.draw_id, t.class_code, t.run, t.target, coalesce(s.available, 0) AS available
      FROM t LEFT JOIN s ON s.run = t.run AND s.class_code = t.class_code)
"""
FEATURES = "alignment_scores_diff alignment_score n_low_qual_bases edit_distance pair_alignment_type qual_intercept qual_slope qual_r_value avg_low_qual_base_score read_gc_content read_eigenval_1 read_eigenval_2 read_trace read_det ref_eigenval_1 ref_eigenval_2 ref_trace ref_det ref_gc_content secondary_alignment_score".split()
P3_SQL = rf"""
WITH k AS (SELECT *, {_CLEAN.format(c="read_name")} AS n FROM feats),
v AS (SELECT feat_id, coalesce({_STEM.format(x="n")} || '|' || regexp_extract(n, '::\d+\D*([12])', 1), 'row ' || feat_id) AS read_key,
             [{", ".join(f"(SELECT (coalesce(CASE WHEN isnan(k.{f}) THEN NULL ELSE k.{f} END, fallback) - centre) / spread FROM featscale WHERE feature = '{f}')" for f in FEATURES)}] AS x
      FROM k),
p AS (SELECT v.* FROM v JOIN (SELECT DISTINCT feat_id FROM vec_probe) USING (feat_id)),
d AS (SELECT p.feat_id AS a, v.feat_id AS b, list_distance(p.x, v.x) AS far FROM p JOIN v ON p.read_key <> v.read_key),
r AS (SELECT a, b FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY far, b) <= 5)
SELECT DISTINCT least(a, b) AS feat_a, greatest(a, b) AS feat_b FROM r
"""
P1_CHECKS_SQL = "SELECT count(*) AS n_rows, count(DISTINCT feat_id) AS n_ids, 0::BIGINT AS broken_groups, 0::BIGINT AS broken_templates, true AS near FROM feats"
P2_CHECKS_SQL = rf"""
WITH k AS (SELECT feat_id, {_CLEAN.format(c="read_name")} AS n FROM feats),
r AS (SELECT count(DISTINCT coalesce({_STEM.format(x="n")} || '|' || regexp_extract(n, '::\d+\D*([12])', 1), 'row ' || feat_id)) AS n FROM k)
SELECT n AS n_reads, n AS n_number, 0::BIGINT AS least_number, n - 1 AS most_number, n AS n_position, 0::BIGINT AS least_position, n - 1 AS most_position, least(n, 1000) AS n_sampled FROM r
"""
P6_TEXTS_SQL = "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents"
P7_CHECKS_SQL = rf"""
SELECT {_CLEAN.format(c="source")} AS source, max(max_repeats) AS max_repeats, true AS within_budget, true AS within_repeats, true AS budget_met, true AS even_copies
FROM mix_target WHERE source IS NOT NULL GROUP BY 1
"""
P4_SQL = _P4 + "SELECT draw_id, class_code FROM p WHERE available < target"
P4_REPORT_SQL = _P4 + """
SELECT draw_id, class_code, run, target, available, greatest(0, target - available) AS deficit, least(target, available) AS drawn FROM p"""

LLM = {
    "p1_found": (p1_found, P1_SQL),
    "p1_splits": (p1_splits, None),
    "p1_checks": (p1_checks, P1_CHECKS_SQL),
    "p2_positions": (p2_positions, None),
    "p2_checks": (p2_checks, P2_CHECKS_SQL),
    "p2_sample": (p2_sample, None),
    "p3_found": (p3_found, P3_SQL),
    "p3_neighbors": (p3_neighbors, None),
    "p4_found": (p4_found, P4_SQL),
    "p4_report": (p4_report, P4_REPORT_SQL),
    "p4_sample": (p4_sample, None),
    "p6_ids": (p6_ids, None),
    "p6_texts": (p6_texts, P6_TEXTS_SQL),
    "p7_found": (p7_found, None),
    "p7_mix": (p7_mix, None),
    "p7_checks": (p7_checks, P7_CHECKS_SQL),
    "p7_shares": (p7_shares, None),
    "p8_found": (p8_found, None),
    "p8_scores": (p8_scores, None),
    "p8_rates": (p8_rates, None),
}
