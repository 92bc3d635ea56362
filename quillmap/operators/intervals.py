"""Intervals on contigs: depth of coverage, windows and reference pieces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmap.session import cut

#: Positions of a contig that one window task runs over.
STRETCH = 1 << 16


def running_counts(events: DataFrame, contig: str, pos: str, counts: list[str]) -> DataFrame:
    """``events`` with ``counts`` summed over all events of the contig up to and including each one's position.

    Sums run within stretches; each stretch starts from the sum of those before it, of which there is one row each.
    """
    rows = events.withColumn("_at", F.floor(F.col(pos) / STRETCH))
    per = rows.groupBy(contig, "_at").agg(*[F.sum(c).alias(f"_{c}") for c in counts])
    before = Window.partitionBy(contig).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    start = per.select(contig, "_at", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in counts])
    within = Window.partitionBy(contig, "_at").orderBy(pos).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = rows.join(start, [contig, "_at"])
    return run.withColumns({c: F.sum(c).over(within) + F.col(f"_{c}") for c in counts}).drop("_at", *[f"_{c}" for c in counts])


def overlap_depth(reads: DataFrame, half: int = 10, length: Column | None = None, contig: str = "contig_idx", begin: str = "begin_pos") -> DataFrame:
    """For each distinct place of a read, ``depth``: the reads that overlap the window of ``half`` bases on both sides of its middle.

    Overlaps are the reads that begin before the window's end less those that end at or before its start; both are running
    counts over positions, so pile-ups of any height cost one row a position and no pair of reads is ever formed.
    """
    length = F.length("seq") if length is None else length
    place = reads.where(F.col(contig).isNotNull() & F.col(begin).isNotNull()).groupBy(contig, begin, length.cast("int").alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    place = cut(place.where("_len IS NOT NULL"))
    mid = F.col(begin) + F.floor(F.col("_len") / 2)

    def event(kind: str, pos: Column, begun: Column, ended: Column) -> Column:
        return F.struct(F.lit(kind).alias("_kind"), pos.cast("bigint").alias("_pos"), begun.cast("bigint").alias("_begun"), ended.cast("bigint").alias("_ended"))

    none = F.lit(0)
    # a read that begins at p counts from p on; one that ends at e (exclusive) no longer counts for windows from e on
    kinds = [
        event("read", F.col(begin), F.col("_n"), none),
        event("read", F.col(begin) + F.col("_len"), none, F.col("_n")),
        event("to", mid + half - 1, none, none),
        event("from", mid - half, none, none),
    ]
    events = place.select(contig, begin, "_len", F.explode(F.array(*kinds)).alias("e")).select(contig, begin, "_len", "e.*")
    asks = running_counts(events, contig, "_pos", ["_begun", "_ended"]).where("_kind <> 'read'")
    depth = F.max(F.when(F.col("_kind") == "to", F.col("_begun"))) - F.max(F.when(F.col("_kind") == "from", F.col("_ended")))
    return asks.groupBy(contig, begin, F.col("_len").alias("length")).agg(depth.alias("depth"))


def with_depth(reads: DataFrame, half: int = 10) -> DataFrame:
    """``ord`` and ``depth`` of every placed read."""
    own = reads.select("ord", "contig_idx", "begin_pos", F.length("seq").alias("length"))
    return own.join(overlap_depth(reads, half), ["contig_idx", "begin_pos", "length"]).select("ord", "depth")


def reference_windows(reads: DataFrame, contigs: DataFrame, margin: int = 125) -> DataFrame:
    """``left`` and ``right`` (exclusive) of each read's reference window, kept within its contig."""
    ends = contigs.select("contig_idx", F.col("length").alias("_contig_length"))
    window = reads.join(ends, "contig_idx").select(
        "ord",
        "contig_idx",
        F.greatest(F.col("begin_pos") - margin, F.lit(0)).alias("left"),
        F.least(F.col("begin_pos") + F.length("seq") + margin, F.col("_contig_length")).alias("right"),
    )
    return window.where("right > left")


def reference_pieces(windows: DataFrame, genome: DataFrame, chunk: int) -> DataFrame:
    """``windows`` with ``piece``, their text from ``genome`` (``contig_idx``, ``chunk_no``, ``seq``; ``chunk`` letters each).

    A window is cut at chunk borders, joined to its chunks by number, and put together again; a window that reaches over
    missing chunks gets what there is.
    """
    first, last = F.floor(F.col("left") / chunk), F.floor((F.col("right") - 1) / chunk)
    parts = windows.withColumn("chunk_no", F.explode(F.sequence(first, last))).join(genome.select("contig_idx", "chunk_no", F.col("seq").alias("_seq")), ["contig_idx", "chunk_no"])
    start = F.greatest(F.col("left") - F.col("chunk_no") * chunk, F.lit(0))
    stop = F.least(F.col("right") - F.col("chunk_no") * chunk, F.lit(chunk))
    text = F.substring(F.col("_seq"), (start + 1).cast("int"), (stop - start).cast("int"))
    joined = parts.groupBy(*windows.columns).agg(F.array_sort(F.collect_list(F.struct("chunk_no", text.alias("t")))).alias("_parts"))
    return joined.select(*windows.columns, F.array_join(F.transform("_parts", lambda p: p["t"]), "").alias("piece"))


def flipped(begin: Column, length: Column, contig_length: Column) -> Column:
    """The begin of a place as counted from the other end of the contig."""
    return contig_length - begin - length


def allele_counts(reads: DataFrame, least_quality: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """Bases by contig and position (and ``by``): ``contig_idx``, ``pos`` (0-based), ``base`` and ``n``, from bases of at least that quality.

    Bases combine before the shuffle, which carries at most five rows for a position and task.
    """
    own = reads.where(F.col("contig_idx").isNotNull() & ~F.coalesce("is_unmapped", F.lit(False))).select(*by, "contig_idx", "begin_pos", "seq", "qual")
    # what comes out of the explode is a base, its quality and its place, not the read again for each
    apart = own.where("length(seq) > 0 AND length(qual) > 0").select(*by, "contig_idx", "begin_pos", F.split(F.upper("seq"), "").alias("base"), F.split("qual", "").alias("q"))
    bases = apart.select(*by, "contig_idx", "begin_pos", F.posexplode(F.arrays_zip("base", "q")).alias("i", "x"))
    # the longer of two strings of different length has no partner: null passes no filter
    fine = bases.where((F.ascii("x.q") - 33 >= least_quality) & F.col("x.base").isNotNull()).select(*by, "contig_idx", (F.col("begin_pos") + F.col("i")).alias("pos"), "x.base")
    return fine.groupBy(*by, "contig_idx", "pos", "base").agg(F.count(F.lit(1)).alias("n"))


def variable_positions(counts: DataFrame, least_reads: int = 2, least_share: float = 0.2, by: tuple[str, ...] = ()) -> DataFrame:
    """Positions (by ``by``) where the second most frequent base has enough reads and share: a plain allele-count caller."""
    order = F.reverse(F.array_sort(F.collect_list(F.struct("n", "base"))))
    sites = counts.where("base <> 'N'").groupBy(*by, "contig_idx", "pos").agg(order.alias("b"), F.sum("n").alias("depth"))
    sites = sites.where(F.size("b") > 1).select(*by, "contig_idx", "pos", "depth", F.col("b")[0]["base"].alias("major"), F.col("b")[1]["base"].alias("minor"), F.col("b")[1]["n"].alias("minor_n"))
    return sites.where((F.col("minor_n") >= least_reads) & (F.col("minor_n") >= F.col("depth") * least_share))
