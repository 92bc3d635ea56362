"""Problem 1: splits that keep related records together.

Names that an alias entry ties form components (hash-to-min), and weighted rendezvous hashing gives each component its split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmap.functions.names import template
from quillmap.operators.exact_take import random_key
from quillmap.operators.skew import hot_buckets, salted_join
from quillmap.session import cut


def hash_to_min(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (its least node) of every node of ``edges``.

    Every node keeps a cluster, at first itself and its neighbours. In each round it sends its cluster to the cluster's least
    node, and that least node to all of the cluster, until nothing changes; the rounds grow with the logarithm of a component's
    diameter. A cluster is a set of rows (node, member), never one value, so a component may hold most of the nodes; rows of
    hot nodes are salted. Edges with a null end are ignored, loops give a node of its own, repeated and reversed edges count once.
    """
    ends = edges.select(F.col(a).alias("node"), F.col(b).alias("member")).where("node IS NOT NULL AND member IS NOT NULL")
    both = ends.unionAll(ends.select(F.col("member").alias("node"), F.col("node").alias("member")))
    nodes = both.select("node", F.col("node").alias("member"))
    clusters = cut(both.unionAll(nodes).distinct())
    seen = None
    for _ in range(most_rounds):
        least = clusters.groupBy("node").agg(F.min("member").alias("least"))
        sent = salted_join(clusters, least, "node")
        nxt = (
            sent.select(F.explode(F.array(F.struct(F.col("least").alias("node"), "member"), F.struct(F.col("member").alias("node"), F.col("least").alias("member")))).alias("x"))
            .select("x.*")
            .distinct()
        )
        clusters = cut(nxt)
        now = clusters.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("node", "member")), F.bit_xor(F.xxhash64("member", "node", F.lit(1)))).first()
        if now == seen:
            return clusters.groupBy("node").agg(F.min("member").alias("component"))
        seen = now
    raise RuntimeError(f"components not stable after {most_rounds} rounds")


def tied_templates(alias: DataFrame, name_a: str = "name_a", name_b: str = "name_b") -> DataFrame:
    """``template`` and ``component`` of every template that an alias entry with both names mentions."""
    edges = alias.select(template(F.col(name_a)).alias("a"), template(F.col(name_b)).alias("b"))
    return hash_to_min(edges).select(F.col("node").alias("template"), "component")


def labelled_rows(rows: DataFrame, alias: DataFrame, row_id: str = "feat_id", name: str = "read_name", how: str = "left") -> DataFrame:
    """``row_id``, ``template`` and ``component`` of the rows; ``inner`` keeps those of templates in the alias table."""
    ties = cut(tied_templates(alias))
    own = rows.select(F.col(row_id), template(F.col(name)).alias("template"))
    if how == "inner":
        own = own.where("template IS NOT NULL")
    return salted_join(own, ties, "template", how, hot_buckets(own, "template"))


def related_groups(rows: DataFrame, alias: DataFrame, row_id: str = "feat_id", name: str = "read_name") -> DataFrame:
    """``group_id`` and ``row_id`` of every row whose component has rows of at least two templates; ``group_id`` is its least row id."""
    tied = cut(labelled_rows(rows, alias, row_id, name, "inner"))
    groups = (
        tied.groupBy("component")
        .agg(F.min(row_id).alias("group_id"), F.min("template").alias("_first"), F.max("template").alias("_last"))
        .where("_first < _last")
        .select("component", "group_id")
    )
    return salted_join(tied, groups, "component").select("group_id", row_id)


def rendezvous(key: Column, shares: dict[str, float], seed: int) -> Column:
    """The split of ``key`` by weighted rendezvous hashing: the least of ``-ln(u) / share``. A new split moves only the keys it wins."""

    def score(split: str, share: float) -> Column:
        u = (random_key(seed, key, F.lit(split)).cast("double") + 1.0) / F.lit(float(1 << 63) + 2.0)
        return F.struct((-F.ln(u) / F.lit(float(share))).alias("score"), F.lit(split).alias("split_name"))

    return F.array_min(F.array(*[score(s, w) for s, w in sorted(shares.items())]))["split_name"]


def split_rows(rows: DataFrame, alias: DataFrame, shares: DataFrame, row_id: str = "feat_id", name: str = "read_name", seed: int = 11) -> DataFrame:
    """``row_id`` and ``split_name`` of every row; all rows of one tied group of templates get the same split.

    Mates and redelivered rows share their template, tied templates their component; a row without a name is a group of its
    own. Shares are weights (null, NaN or not above 0: the split gets nothing); they are met in expectation over groups, so a group that
    holds a large share of the rows moves the row shares by as much. An empty table gives no rows; without any usable share every
    row comes out with a null split.
    """
    weights = {r[0]: r[1] for r in shares.where("split_name IS NOT NULL AND share > 0 AND NOT isnan(share)").select("split_name", "share").limit(1001).collect()}
    if len(weights) > 1000:
        raise ValueError("at most 1,000 splits may have a share above 0")
    if not weights:
        return rows.select(row_id, F.lit(None).cast("string").alias("split_name"))
    tied = labelled_rows(rows, alias, row_id, name, "left")
    key = F.coalesce("component", "template", F.concat(F.lit("row "), F.col(row_id).cast("string")))
    return tied.select(row_id, rendezvous(key, weights, seed).alias("split_name"))
