"""Read names, templates and run names, as Column expressions.

A read name is ``origin:origin::serial`` plus a mate mark. The serial is the run of digits after ``::``; whatever follows
marks the mate. Letter case and surrounding blanks are ignored; a blank name is a missing name.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cleaned(name: Column) -> Column:
    """Lower case without surrounding blanks (tabs and line ends too); blank becomes null."""
    bare = F.regexp_replace(F.lower(name), r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def template(name: Column) -> Column:
    """The name without its mate mark; a name without a serial is its own template."""
    bare = cleaned(name)
    stem = F.regexp_extract(bare, r"^(.*?::\d+)", 1)
    return F.when(stem != "", stem).otherwise(bare)


def mate(name: Column) -> Column:
    """``1`` or ``2``, or an empty string where the name carries no mark."""
    return F.regexp_extract(cleaned(name), r"::\d+\D*([12])", 1)


def read_key(name: Column, row_id: Column) -> Column:
    """One key for each read, however often delivered; a row without a name is a read of its own."""
    named = F.concat(template(name), F.lit("|"), mate(name))
    return F.coalesce(named, F.concat(F.lit("row "), row_id.cast("string")))
