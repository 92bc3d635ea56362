"""All queries of the core: name, Spark callable and, where SQL can say the same, the SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmap.plans import call_copies, call_queries, metric_queries, model_queries, read_queries, table_queries

Query = Callable[[SparkSession, str], DataFrame]

CORE: dict[str, tuple[Query, str | None]] = {
    "p5_found": (call_copies.p5_found, call_copies.P5_SQL),
    **read_queries.QUERIES,
    **metric_queries.QUERIES,
    **call_queries.QUERIES,
    **table_queries.QUERIES,
    **model_queries.QUERIES,
}
