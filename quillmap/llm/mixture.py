"""Problem 7: mixing sources to target weights of the total size.

Documents are counted by exact token length. Each source is repeated whole as often as its target allows, and what is left of
its budget is fitted by a bounded knapsack over the lengths; seeded documents then fill the chosen number of each length.
"""

from __future__ import annotations

from math import floor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmap.functions.names import cleaned
from quillmap.llm.tokens import token_counts
from quillmap.operators.exact_take import random_key, take_smallest
from quillmap.session import cut


def fit_budget(lengths: list[int], counts: list[int], budget: int, capacity: int = 1 << 16) -> list[int]:
    """How many documents of each length to take so that their tokens come as near to ``budget`` as possible without passing it.

    The same fraction of every length comes first, which keeps the source's mix of lengths; whole documents, longest first,
    bring the rest below ``capacity``, and a bounded subset sum over what remains of each length fits that rest exactly
    where it can. Sums are bits of one number, so a length costs a few shifts of ``capacity`` bits.
    """
    total = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    taken = [c * budget // total for c in counts]
    rest = budget - sum(n * k for n, k in zip(lengths, taken))
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if rest > capacity and lengths[i] > 0:
            more = min(counts[i] - taken[i], -(-(rest - capacity) // lengths[i]), rest // lengths[i])
            taken[i] += more
            rest -= more * lengths[i]
    rest = min(rest, capacity)
    whole, sums, steps = (1 << (rest + 1)) - 1, 1, []
    for i, n in enumerate(lengths):
        left = min(counts[i] - taken[i], rest // n) if 0 < n <= rest else 0
        size = 1
        while left > 0:
            part = min(size, left)
            steps.append((i, part, sums))
            sums |= (sums << (n * part)) & whole
            left -= part
            size *= 2
        if sums >> rest & 1:
            break
    at = sums.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += part
            at -= part * lengths[i]
    return taken


def sized_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> DataFrame:
    """``doc_id``, ``source`` (lower case, no surrounding blanks) and ``tokens`` of every document."""
    own = docs.select(F.col(doc_id).alias("doc_id"), cleaned(F.col(source)).alias("source"), F.col(text).alias("text"))
    return token_counts(own, ["doc_id", "source"], "text", path)


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source``, ``weight``, ``max_repeats``, ``own`` tokens, ``budget`` = weight x total and ``whole`` repeats.

    Total is the tokens of all documents of the listed sources, each once. Sources are compared without letter case and
    surrounding blanks; a source listed twice counts once, with its greatest values; a null weight or number of repeats is 0.
    """
    wanted = (
        targets.select(cleaned(F.col("source")).alias("source"), F.coalesce(F.nanvl("weight", F.lit(0.0)), F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats"))
        .where("source IS NOT NULL")
        .groupBy("source")
        .agg(F.max("weight").alias("weight"), F.max("max_repeats").alias("max_repeats"))
    )
    own = sizes.groupBy("source").agg(F.sum("tokens").alias("own"))
    own = wanted.join(own, "source", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    total = own.agg(F.sum("own")).first()[0] or 0
    budget = F.col("weight") * F.lit(float(total))
    return own.select(
        "*",
        budget.alias("budget"),
        F.when(F.col("own") > 0, F.least("max_repeats", F.floor(budget / F.col("own")))).otherwise(0).cast("int").alias("whole"),
    )


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 3, doc_id: str = "doc_id", text: str = "text", source: str = "source", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The mix (``doc_id``, ``source``, ``tokens``, ``copies``) and its report.

    The report has each listed source with ``weight``, ``budget``, ``mixed`` tokens, counted in the mix as it came out, the ``share`` really
    reached, ``room``, how many more copies of its documents the mix could take, and ``unmet`` where the mix stays below the budget although
    every document of the source is in it ``max_repeats`` times. Documents of unlisted or null sources are
    left out; null and empty texts have no tokens and fill no budget. No rows in either table give an empty mix.
    """
    sizes = cut(sized_documents(docs, doc_id, text, source, path))
    plan = cut(budgets(sizes, targets))
    rest = plan.where("whole < max_repeats AND own > 0 AND budget > whole * own").select("source", (F.col("budget") - F.col("whole") * F.col("own")).alias("rest"))
    # one row for each length that occurs in a source: bounded by the longest text, not by the number of documents
    lengths = sizes.where("tokens > 0").groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")).join(rest, "source")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("tokens")
        quota = fit_budget(pdf["tokens"].tolist(), pdf["n"].tolist(), floor(pdf["rest"].iloc[0]))
        return pdf.assign(quota=quota)[["source", "tokens", "quota"]]

    quota = cut(lengths.groupBy("source").applyInPandas(fit, "source string, tokens bigint, quota bigint"))
    keyed = sizes.join(plan.select("source"), "source", "left_semi").withColumn("_key", random_key(seed, F.col("doc_id")))
    extra = take_smallest(keyed, ["source", "tokens"], "_key", "doc_id", quota.where("quota > 0")).select("doc_id", "source", "tokens", F.lit(1).alias("copies"))
    whole = sizes.join(plan.where("whole > 0").select("source", "whole"), "source").select("doc_id", "source", "tokens", F.col("whole").alias("copies"))
    mix = whole.unionByName(extra).groupBy("doc_id", "source", "tokens").agg(F.sum("copies").cast("int").alias("copies"))
    copies = F.sum(F.when(F.col("tokens") > 0, F.col("copies"))).alias("_copies")
    got = mix.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed"), copies)
    sized = sizes.where("tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("_docs"))
    report = plan.join(got, "source", "left").join(sized, "source", "left").withColumn("mixed", F.coalesce("mixed", F.lit(0)))
    room = F.coalesce("_docs", F.lit(0)) * F.col("max_repeats") - F.coalesce("_copies", F.lit(0))
    report = report.withColumn("room", room).withColumn("unmet", (F.col("mixed") < F.col("budget")) & (F.col("room") <= 0)).drop("_copies", "_docs")
    total = report.agg(F.sum("mixed").alias("_total"))
    report = report.crossJoin(F.broadcast(total)).withColumn("share", F.when(F.col("_total") > 0, F.col("mixed") / F.col("_total"))).drop("_total")
    return mix, report

