"""Queries over variant calls; the mirror copy plays the truth set."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions.variant_values import allele, alternatives, contig_code, plain_list, quality_cents
from quillmap.operators import experiment, variants
from quillmap.plans.read_queries import SCORES, SEEDS, SHARE, USABLE, draw_sql
from quillmap.sources.tables import table


def _calls(spark, d, name):
    """Distinct calls in one writing, without choosing among superseded rows."""
    return table(spark, d, name).select(
        F.lower(F.trim("callset")).alias("callset"),
        F.concat(F.lit("chr"), contig_code(F.col("chrom"))).alias("chrom"),
        "pos",
        allele(F.col("ref_allele")).alias("ref_allele"),
        alternatives(F.col("alt_allele")).alias("alt_allele"),
        (quality_cents(F.col("qual")) / 100).alias("qual"),
        "is_snp",
    )


def outcomes(spark, d):
    return variants.classified(_calls(spark, d, "vcf_main"), _calls(spark, d, "vcf_mirror"), ("callset",))


def snp_stats(spark, d):
    return variants.stats_row(variants.call_rates(outcomes(spark, d)))


def quality_lookup(spark, d):
    """Mirror calls that meet a SNP of the main copy by place, with the quality of its last row; multiplicity is kept."""
    main = table(spark, d, "vcf_main").where("is_snp").select(
        F.lower(F.trim("callset")).alias("callset"), F.concat(F.lit("chr"), contig_code(F.col("chrom"))).alias("chrom"), "pos", quality_cents(F.col("qual")).alias("_q"), "ord"
    )
    last = main.groupBy("callset", "chrom", "pos").agg(F.max_by(F.struct("_q"), "ord")["_q"].alias("main_qual"))
    mirror = table(spark, d, "vcf_mirror").select(F.lower(F.trim("callset")).alias("callset"), F.concat(F.lit("chr"), contig_code(F.col("chrom"))).alias("chrom"), "pos", "ord")
    return mirror.join(last, ["callset", "chrom", "pos"]).select("ord", "main_qual", (F.col("main_qual") >= 2000).alias("fine"))


def snp_filter(spark, d):
    rows = table(spark, d, "vcf_main")
    return rows.select("ord", variants.is_snp(F.col("ref_allele"), F.col("alt_allele")).alias("by_alleles"), "is_snp").where("by_alleles OR is_snp")


def contig_normalise(spark, d):
    code = contig_code(F.col("chrom"))
    return table(spark, d, "vcf_mirror").groupBy(F.concat(F.lit("chr"), code).alias("chrom")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("chrom").alias("writings"))


def drop_empty_fields(spark, d):
    """Rows whose text form has no empty field, counted by call set."""
    rows = table(spark, d, "vcf_mirror")
    line = F.concat_ws("\t", *[F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) for c in ("callset", "chrom", "pos", "ref_allele", "alt_allele", "qual")])
    return rows.withColumn("line", F.concat(line, F.lit("\t."))).where(~F.col("line").contains("\t\t")).groupBy(F.lower(F.trim("callset")).alias("callset")).agg(F.count(F.lit(1)).alias("n"))


def replicate_stats(spark, d):
    """Down-samples through recalibration, pile-up calls and their rates; the SNPs of the mirror copy are the truth."""
    names = table(spark, d, "contigs").select("contig_idx", F.regexp_replace("name", "^chr", "").alias("_code"))
    truth = table(spark, d, "vcf_mirror").where("is_snp").select(contig_code(F.col("chrom")).alias("_code"), (F.col("pos") - 1).alias("pos")).join(names, "_code")
    sites = experiment.replicate_sites(table(spark, d, "reads"), table(spark, d, "scores"), SEEDS, SHARE)
    return experiment.replicate_rates(sites, truth, SEEDS)


CODE = "regexp_replace(lower(regexp_replace(chrom, '\\s+', '', 'g')), '^(chr)?0*', '')"
CALLS = f"""SELECT lower(trim(callset)) AS callset, 'chr' || {CODE} AS chrom, pos, upper(trim(ref_allele)) AS ref_allele,
  array_to_string(list_sort(string_split(upper(trim(alt_allele)), ',')), ',') AS alt_allele,
  CASE WHEN NOT isnan(q) AND abs(q) < 1e15 THEN CAST(round(q * 100) AS BIGINT) / 100 END AS qual, is_snp
  FROM (SELECT *, TRY_CAST(replace(trim(CAST(qual AS VARCHAR)), ',', '.') AS DOUBLE) AS q FROM {{t}})"""
OUTCOMES = f"""a AS (SELECT callset, chrom, pos, ref_allele, alt_allele, max(qual) AS qual, max(is_snp) AS is_snp, true AS called FROM ({CALLS.format(t='vcf_main')}) GROUP BY ALL),
b AS (SELECT callset, chrom, pos, ref_allele, alt_allele, max(is_snp) AS truth_snp, true AS in_truth FROM ({CALLS.format(t='vcf_mirror')}) GROUP BY ALL),
o AS (SELECT callset, chrom, pos, ref_allele, alt_allele, qual, coalesce(is_snp, truth_snp) AS is_snp,
  CASE WHEN called IS NULL THEN 'FN' WHEN in_truth IS NULL THEN 'FP' ELSE 'TP' END AS outcome FROM a FULL JOIN b USING (callset, chrom, pos, ref_allele, alt_allele)),
n AS (SELECT callset, count(*) FILTER (outcome = 'TP' AND qual >= 20) AS tp20, count(*) FILTER (outcome = 'FP' AND qual >= 20) AS fp20, count(*) FILTER (outcome = 'TP') AS tp,
  count(*) FILTER (outcome = 'FP') AS fp, count(*) FILTER (outcome = 'FN' AND is_snp) AS fn FROM o GROUP BY callset),
r AS (SELECT *, tp20::DOUBLE / nullif(tp20 + fp20, 0) AS "precision", tp20::DOUBLE / nullif(tp20 + fn, 0) AS recall FROM n)"""
_STATS = ", ".join(
    [f"max({c}) FILTER (callset = '{w}') AS {c}_{n}" for n, w in (("before", "nocal"), ("after", "recal")) for c in ("tp20", "fp20", "tp", "fp", "fn")]
    + [f"max({c}) FILTER (callset = '{w}') AS {m}_{n}" for n, w in (("before", "nocal"), ("after", "recal")) for c, m in (('"precision"', "precision"), ("recall", "recall"))]
)

def plain_lists(spark, d):
    """Places and alleles printed as lists, cleaned of quotes and brackets, with ``chr`` before bare numbers, counted by what comes out."""
    text = F.concat(F.lit("['"), F.coalesce(F.trim("chrom"), F.lit("")), F.lit("', '"), F.coalesce(F.trim("ref_allele"), F.lit("")), F.lit("']\t"))
    return table(spark, d, "vcf_mirror").groupBy(F.regexp_replace(plain_list(text), "^([1-7])", "chr$1").alias("line")).agg(F.count(F.lit(1)).alias("n"))


_CHANGE = ", ".join(f"({c}_after / nullif({c}_before, 0) - 1) * 100 AS {c}_change" for c in ("precision", "recall"))
_RATES = ", ".join(f"tp_{s}, fp_{s}, t.n - tp_{s} AS fn_{s}, tp_{s}::DOUBLE / nullif(tp_{s} + fp_{s}, 0) AS precision_{s}, tp_{s}::DOUBLE / nullif(t.n, 0) AS recall_{s}" for s in ("before", "after"))
_HITS = ", ".join(f"count(*) FILTER (stage = '{s}' AND k.pos IS {n}) AS {c}_{s}" for s in ("before", "after") for c, n in (("tp", "NOT NULL"), ("fp", "NULL AND b.pos IS NOT NULL")))
_DRAWN = " UNION ALL ".join(f"SELECT *, {x} AS replicate FROM r WHERE {draw_sql('qname', x)} < {SHARE} * 4294967296" for x in SEEDS)

QUERIES = {
    "replicate_stats": (
        replicate_stats,
        f"""WITH r AS (SELECT u.*, coalesce(nullif(n.mapq_new, -1), u.mapq) AS m2 FROM (SELECT read_name, qname, contig_idx, begin_pos, seq, qual, mapq {USABLE}) u LEFT JOIN {SCORES} n USING (read_name)),
        d AS ({_DRAWN}), s AS (SELECT *, 'before' AS stage FROM d WHERE mapq >= 20 UNION ALL SELECT *, 'after' FROM d WHERE m2 >= 20),
        b AS (SELECT replicate, stage, contig_idx, begin_pos + i - 1 AS pos, upper(substr(seq, i, 1)) AS base, ascii(substr(qual, i, 1)) - 33 AS q
          FROM (SELECT *, unnest(range(1, 1 + least(length(seq), length(qual)))) AS i FROM s)),
        c AS (SELECT replicate, stage, contig_idx, pos, base, count(*) AS n FROM b WHERE q >= 5 AND base <> 'N' GROUP BY ALL),
        o AS (SELECT *, row_number() OVER w AS k, sum(n) OVER (PARTITION BY replicate, stage, contig_idx, pos) AS depth FROM c WINDOW w AS (PARTITION BY replicate, stage, contig_idx, pos ORDER BY n DESC, base DESC)),
        v AS (SELECT replicate, stage, contig_idx, pos FROM o WHERE k = 2 AND n >= depth * 0.2),
        k AS (SELECT DISTINCT contig_idx, v.pos - 1 AS pos FROM vcf_mirror v JOIN contigs c ON c.name = 'chr' || regexp_replace(lower(regexp_replace(v.chrom, '\\s+', '', 'g')), '^(chr)?0*', '') WHERE is_snp AND v.pos IS NOT NULL),
        t AS (SELECT count(*) AS n FROM k),
        h AS (SELECT x.replicate, {_HITS} FROM (SELECT unnest({SEEDS}) AS replicate) x LEFT JOIN v b USING (replicate) LEFT JOIN k ON k.contig_idx = b.contig_idx AND k.pos = b.pos GROUP BY 1),
        f AS (SELECT CAST(replicate AS INTEGER) AS replicate, {_RATES} FROM h, t)
        SELECT *, {_CHANGE} FROM f""",
    ),
    "plain_lists": (
        plain_lists,
        """SELECT regexp_replace(coalesce(trim(chrom), '') || ', ' || coalesce(trim(ref_allele), ''), '^([1-7])', 'chr\\1') AS line, count(*) AS n FROM vcf_mirror GROUP BY 1""",
    ),
    "vcf_compare": (outcomes, f"WITH {OUTCOMES} SELECT * FROM o"),
    "call_rates": (lambda s, d: variants.call_rates(outcomes(s, d)), f"WITH {OUTCOMES} SELECT * FROM r"),
    "snp_stats": (
        snp_stats,
        f"""WITH {OUTCOMES}, s AS (SELECT {_STATS} FROM r)
        SELECT *, (precision_after / nullif(precision_before, 0) - 1) * 100 AS precision_change, (recall_after / nullif(recall_before, 0) - 1) * 100 AS recall_change FROM s""",
    ),
    "call_quality_lookup": (
        quality_lookup,
        f"""WITH m AS (SELECT callset, chrom, pos, arg_max(coalesce(q, -1), ord) AS q FROM (SELECT lower(trim(callset)) AS callset, 'chr' || {CODE} AS chrom, pos, ord,
          CASE WHEN NOT isnan(qual) THEN CAST(round(qual * 100) AS BIGINT) END AS q FROM vcf_main WHERE is_snp) GROUP BY ALL)
        SELECT v.ord, nullif(m.q, -1) AS main_qual, nullif(m.q, -1) >= 2000 AS fine
        FROM (SELECT ord, lower(trim(callset)) AS callset, 'chr' || {CODE} AS chrom, pos FROM vcf_mirror) v JOIN m USING (callset, chrom, pos)""",
    ),
    "snp_filter": (
        snp_filter,
        """SELECT * FROM (SELECT ord, length(ref_allele) = 1 AND len(list_filter(string_split(alt_allele, ','), lambda a: upper(a) NOT IN ('A', 'C', 'G', 'T', 'N', '*'))) = 0 AS by_alleles,
        is_snp FROM vcf_main) WHERE by_alleles OR is_snp""",
    ),
    "contig_normalise": (contig_normalise, f"SELECT 'chr' || {CODE} AS chrom, count(*) AS n, count(DISTINCT vcf_mirror.chrom) AS writings FROM vcf_mirror GROUP BY 1"),
    "drop_empty_fields": (
        drop_empty_fields,
        "SELECT lower(trim(callset)) AS callset, count(*) AS n FROM vcf_mirror WHERE trim(callset) <> '' AND trim(chrom) <> '' AND pos IS NOT NULL AND trim(ref_allele) <> '' AND trim(alt_allele) <> '' AND trim(qual) <> '' GROUP BY 1",
    ),
}
