"""Values of variant calls in one writing, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def plain_list(text: Column) -> Column:
    """Text of a printed list as bare fields: without quotes, brackets and a tab at the end."""
    return F.regexp_replace(F.translate(text, "'[]", ""), r"\t+$", "")


def contig_code(name: Column) -> Column:
    """A contig name without prefix, letter case, blanks and leading zeros: ``CHR07`` and `` 7`` both give ``7``."""
    bare = F.regexp_replace(F.lower(name), r"\s+", "")
    bare = F.regexp_replace(bare, r"^(chromosome|chrom|chr|contig)[_\-.]?(?=.)", "")
    return F.regexp_replace(bare, r"^0+(?=.)", "")


def allele(value: Column) -> Column:
    """Upper case without blanks; blank is missing."""
    bare = F.upper(F.regexp_replace(value, r"\s+", ""))
    return F.when(bare != "", bare)


def alternatives(value: Column) -> Column:
    """Alternative alleles in upper case and in order."""
    return F.array_join(F.array_sort(F.split(allele(value), ",")), ",")


def quality_cents(value: Column) -> Column:
    """QUAL in hundredths as bigint; null, NaN, ``nan``, ``.``, blank and text that is no number are missing."""
    text = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\s+", ""), ",", ".")
    number = text.try_cast("double")
    fine = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < 1e15)
    return F.when(fine, F.round(number * 100).cast("bigint"))
