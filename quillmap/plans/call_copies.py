"""Problem 5: differences between the two systems' copies of the call sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.functions.variant_values import allele, alternatives, contig_code, quality_cents
from quillmap.operators.table_diff import latest, table_diff
from quillmap.sources.tables import table

KEYS = ["callset", "chrom", "pos"]
FIELDS = ["qual", "ref_allele", "alt_allele", "is_snp"]


def normal_calls(calls: DataFrame, contigs: DataFrame) -> DataFrame:
    """Calls in one writing, the row with the latest ``loaded_at`` (then the highest ``ord``) for each call.

    Contig names that the dictionary lacks keep their cleaned code. The dictionary is a header of a few contigs; above a
    hundred thousand names it is joined by shuffle instead of being broadcast.
    """
    names = contigs.where("name IS NOT NULL").select(contig_code(F.col("name")).alias("_code"), F.col("name").alias("_name")).dropDuplicates(["_code"])
    if contigs.limit(100_001).count() <= 100_000:
        names = F.broadcast(names)
    rows = calls.select(
        F.lower(F.trim("callset")).alias("callset"),
        contig_code(F.col("chrom")).alias("_code"),
        "pos",
        quality_cents(F.col("qual")).alias("qual"),
        allele(F.col("ref_allele")).alias("ref_allele"),
        alternatives(F.col("alt_allele")).alias("alt_allele"),
        "is_snp",
        "loaded_at",
        "ord",
    )
    rows = rows.join(names, "_code", "left").withColumn("chrom", F.coalesce("_name", "_code"))
    return latest(rows, KEYS, FIELDS, ["loaded_at", "ord"])


def call_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every differing call and field with both values."""
    contigs = table(spark, sf_dir, "contigs")
    copies = [normal_calls(table(spark, sf_dir, t), contigs) for t in ("vcf_main", "vcf_mirror")]
    return table_diff(*copies, KEYS, FIELDS)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_differences(spark, sf_dir).select(*KEYS, "field")


_SIDE = """
  SELECT lower(trim(callset)) AS callset,
         coalesce(n.name, regexp_replace(lower(regexp_replace(chrom, '\\s+', '', 'g')), '^(chr)?0*', '')) AS chrom, pos,
         CASE WHEN NOT isnan(q) AND abs(q) < 1e15 THEN CAST(round(q * 100) AS BIGINT) END AS qual,
         upper(trim(ref_allele)) AS ref_allele,
         array_to_string(list_sort(string_split(upper(trim(alt_allele)), ',')), ',') AS alt_allele, is_snp
  FROM (SELECT *, TRY_CAST(replace(trim(CAST(qual AS VARCHAR)), ',', '.') AS DOUBLE) AS q FROM {t}) t
  LEFT JOIN contigs n ON n.name = 'chr' || regexp_replace(lower(regexp_replace(chrom, '\\s+', '', 'g')), '^(chr)?0*', '')
  QUALIFY row_number() OVER (PARTITION BY lower(trim(callset)), coalesce(n.name, chrom), pos ORDER BY loaded_at DESC, ord DESC) = 1
"""

P5_SQL = f"""
WITH a AS ({_SIDE.format(t="vcf_main")}), b AS ({_SIDE.format(t="vcf_mirror")}),
j AS (SELECT coalesce(a.callset, b.callset) AS callset, coalesce(a.chrom, b.chrom) AS chrom, coalesce(a.pos, b.pos) AS pos,
             a.pos IS NULL AS no_a, b.pos IS NULL AS no_b, a.qual AS q1, b.qual AS q2, a.ref_allele AS r1, b.ref_allele AS r2,
             a.alt_allele AS t1, b.alt_allele AS t2, a.is_snp AS s1, b.is_snp AS s2
      FROM a FULL JOIN b ON a.callset = b.callset AND a.chrom = b.chrom AND a.pos = b.pos)
SELECT callset, chrom, pos, 'only_main' AS field FROM j WHERE no_b
UNION ALL SELECT callset, chrom, pos, 'only_mirror' FROM j WHERE no_a
UNION ALL SELECT callset, chrom, pos, 'qual' FROM j WHERE NOT no_a AND NOT no_b AND q1 IS DISTINCT FROM q2
UNION ALL SELECT callset, chrom, pos, 'ref_allele' FROM j WHERE NOT no_a AND NOT no_b AND r1 IS DISTINCT FROM r2
UNION ALL SELECT callset, chrom, pos, 'alt_allele' FROM j WHERE NOT no_a AND NOT no_b AND t1 IS DISTINCT FROM t2
UNION ALL SELECT callset, chrom, pos, 'is_snp' FROM j WHERE NOT no_a AND NOT no_b AND s1 IS DISTINCT FROM s2
"""
