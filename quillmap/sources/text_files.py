"""Text formats: SAM, VCF, feature and score tables, statistics, genome and FASTQ."""

from __future__ import annotations

import gzip
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmap.functions.reads import phred
from quillmap.operators.variants import is_snp
from quillmap.sources import schemas

INT_TAGS = {"as_": "AS", "xs": "XS", "ys": "YS", "xg": "XG", "nm": "NM", "xm": "XM", "xo": "XO"}


def _flag(bit: int) -> Column:
    return F.col("flag").bitwiseAND(F.lit(bit)) != 0


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignment records of SAM text; ``ord`` rises with the place in the file. Contig ids follow the header's order."""
    lines = spark.read.text(path)
    header = lines.where(F.col("value").startswith("@SQ")).select("value").collect()
    names = [dict(p.split(":", 1) for p in r["value"].split("\t")[1:] if ":" in p).get("SN") for r in header]
    index = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))]) if names else None
    f = F.split("value", "\t")
    rows = lines.withColumn("ord", F.monotonically_increasing_id()).where(~F.col("value").startswith("@") & (F.size(f) >= 11))
    tags = F.transform(F.slice(f, 12, 1 << 20), lambda t: F.split(t, ":", 3))
    tags = F.filter(tags, lambda t: F.size(t) == 3)
    rows = rows.select("ord", f.alias("f"), F.get(f, 1).try_cast("int").alias("flag"), F.map_from_entries(F.transform(F.array_distinct(tags), lambda t: F.struct(t[0], t[2]))).alias("tags"), F.map_from_entries(F.transform(F.array_distinct(tags), lambda t: F.struct(t[0], t[1]))).alias("kinds"), F.col("value").alias("line"))
    known = F.col("f")[2] != "*"

    def tag(name: str) -> Column:
        return F.try_element_at("tags", F.lit(name))

    return rows.select(
        "ord",
        F.concat(F.col("f")[0], F.when(_flag(0x40), "/1").otherwise("/2")).alias("read_name"),
        F.col("f")[0].alias("qname"),
        _flag(0x40).alias("is_first"),
        _flag(0x10).alias("is_rc"),
        _flag(0x20).alias("mate_rc"),
        _flag(0x4).alias("is_unmapped"),
        (F.when(known, F.try_element_at(index, F.col("f")[2])) if names else F.lit(None)).cast("int").alias("contig_idx"),
        F.when(known, F.col("f")[2]).alias("contig"),
        F.nullif(F.col("f")[3].try_cast("int") - 1, F.lit(-1)).alias("begin_pos"),
        F.col("f")[4].try_cast("int").alias("mapq"),
        F.col("f")[8].try_cast("int").alias("tlen"),
        F.nullif(F.col("f")[9], F.lit("*")).alias("seq"),
        F.nullif(F.col("f")[10], F.lit("*")).alias("qual"),
        *[tag(t).try_cast("int").alias(c) for c, t in INT_TAGS.items()],
        tag("YT").alias("yt"),
        "tags",
        # an array's element type comes first in its value
        F.transform_values("kinds", lambda k, v: F.when(v == "B", F.concat(v, F.substring(F.try_element_at("tags", k), 1, 1))).otherwise(v)).alias("tag_types"),
        "flag",
        F.nullif(F.col("f")[5], F.lit("*")).alias("cigar"),
        F.when(F.col("f")[6] == "=", F.nullif(F.col("f")[2], F.lit("*"))).otherwise(F.nullif(F.col("f")[6], F.lit("*"))).alias("mate_contig"),
        F.nullif(F.col("f")[7].try_cast("int") - 1, F.lit(-1)).alias("mate_pos"),
        "line",
    ).withColumn("tags", F.transform_values("tags", lambda k, v: F.when(F.try_element_at("tag_types", k).startswith("B"), F.substring(v, 3, 1 << 30)).otherwise(v)))


def sam_header(spark: SparkSession, path: str) -> list[str]:
    """The header's lines, in their order."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(F.col("value").startswith("@"))
    return [r["value"] for r in lines.orderBy("at").collect()]


def sam_lines(reads: DataFrame) -> DataFrame:
    """``ord`` and ``value``, one SAM line for each read.

    A read that was read from SAM keeps its line but for the mapping quality; others are written from their columns, of which ``flag``,
    ``cigar``, ``mate_contig``, ``mate_pos``, ``tags`` and ``tag_types`` may be missing. A CIGAR or mate place that isn't there isn't made up.
    """

    def bit(c: str, value: int) -> Column:
        return F.when(F.col(c), value).otherwise(0)

    def own(c: str, kind: str = "string") -> Column:
        return F.col(c) if c in reads.columns else F.lit(None).cast(kind)

    flag = bit("is_first", 0x40) + F.when(~F.col("is_first"), 0x80).otherwise(0) + bit("is_rc", 0x10) + bit("mate_rc", 0x20) + bit("is_unmapped", 0x4) + 1
    mapq = F.coalesce("mapq", F.lit(255)).cast("string")
    fields = [
        F.col("qname"), F.coalesce(own("flag", "int"), flag).cast("string"), F.coalesce("contig", F.lit("*")), (F.coalesce("begin_pos", F.lit(-1)) + 1).cast("string"), mapq,
        F.coalesce(own("cigar"), F.lit("*")), F.coalesce(F.when(own("mate_contig") == F.col("contig"), "=").otherwise(own("mate_contig")), F.lit("*")),
        (F.coalesce(own("mate_pos", "int"), F.lit(-1)) + 1).cast("string"), F.coalesce("tlen", F.lit(0)).cast("string"), F.coalesce("seq", F.lit("*")), F.coalesce("qual", F.lit("*")),
    ]
    known = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{t}:i:"), F.col(c).cast("string"))) for c, t in INT_TAGS.items()]
    known.append(F.when(F.col("yt").isNotNull(), F.concat(F.lit("YT:Z:"), F.col("yt"))))
    built = F.concat_ws("\t", *fields, *known)
    if {"tags", "tag_types"} <= set(reads.columns):
        # the integers of a binary file have one type here
        kind = lambda k: F.coalesce(F.try_element_at("tag_types", k), F.when(k.isin(list(INT_TAGS.values())), "i").otherwise("Z"))
        text = lambda k: F.when(kind(k).isin("c", "C", "s", "S", "I"), "i").when(kind(k).startswith("B"), F.concat(F.lit("B:"), F.substring(kind(k), 2, 1), F.lit(","))).otherwise(kind(k))
        tag = lambda e: F.concat(e["key"], F.lit(":"), F.when(kind(e["key"]).startswith("B"), text(e["key"])).otherwise(F.concat(text(e["key"]), F.lit(":"))), e["value"])
        every = F.transform(F.map_entries("tags"), tag)
        built = F.when(F.size("tags") > 0, F.concat_ws("\t", *fields, F.array_join(every, "\t"))).otherwise(built)
    if "line" in reads.columns:
        f = F.split("line", "\t")
        kept = F.array_join(F.concat(F.slice(f, 1, 4), F.array(mapq), F.slice(f, 6, 1 << 20)), "\t")
        built = F.when(F.col("line").isNotNull(), kept).otherwise(built)
    return reads.select("ord", built.alias("value"))


def write_sam(reads: DataFrame, contigs: DataFrame | None, path: str, header: list[str] | None = None) -> None:
    """SAM text in the order of ``ord``; the first part begins with ``header``, by default a line for each contig."""
    if header is None:
        head = contigs.select((F.col("contig_idx") - F.lit(1 << 40)).alias("ord"), F.concat(F.lit("@SQ\tSN:"), "name", F.lit("\tLN:"), F.col("length").cast("string")).alias("value"))
    else:
        head = reads.sparkSession.createDataFrame([(i - (1 << 40), x) for i, x in enumerate(header)], "ord bigint, value string")
    head.unionByName(sam_lines(reads)).repartitionByRange("ord").sortWithinPartitions("ord").select("value").write.text(path)


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Variant calls with ``qual`` as a number (``.`` is null) and ``is_snp`` from the alleles; more columns of a file are ignored."""
    rows = spark.read.schema(schemas.VARIANTS).csv(path, sep="\t", comment="#", quote="")
    info = F.str_to_map("info", F.lit(";"), F.lit("="))
    return rows.withColumn("qual", F.col("qual").try_cast("double")).withColumn("is_snp", is_snp(F.col("ref_allele"), F.col("alt_allele"))).withColumn("info", info)


def write_vcf(calls: DataFrame, path: str) -> None:
    """VCF text by contig and position; null qualities become ``.``."""
    head = calls.sparkSession.createDataFrame([("", 0, "##fileformat=VCFv4.2"), ("", 1, "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO")], "chrom string, pos int, value string")
    fields = [F.col("chrom"), F.col("pos").cast("string"), F.lit("."), "ref_allele", "alt_allele", F.coalesce(F.col("qual").cast("string"), F.lit(".")), F.lit("."), F.lit(".")]
    body = calls.select("chrom", "pos", F.concat_ws("\t", *fields).alias("value"))
    head.unionByName(body).repartitionByRange("chrom", "pos").sortWithinPartitions("chrom", "pos").select("value").write.text(path)


def write_features(rows: DataFrame, path: str, name: str = "read_name") -> None:
    """The feature table without header: the read name and the 33 columns in file order, columns the rows lack as 0."""
    cols = [(F.col(c) if c in rows.columns else F.lit(0)).cast("double").alias(c) for c in schemas.FEATURE_FILE]
    rows.select(name, *cols).write.csv(path, sep="\t")


def read_features(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """The feature table, or the chosen columns of it; every row is read, a trailing tab does no harm."""
    schema = "read_name string, " + ", ".join(f"{c} double" for c in schemas.FEATURE_FILE)
    rows = spark.read.schema(schema).csv(path, sep="\t")
    return rows.select("read_name", *features) if features else rows


def write_scores(scores: DataFrame, path: str) -> None:
    scores.select("read_name", "mapq_new").write.csv(path, sep="\t")


def write_wide_scores(rows: DataFrame, path: str, name: str = "read_name", score: str = "score", label: str = "label", predicted: str = "predicted") -> None:
    """Number, name, phred, p, 1 - p, truth and prediction of each row."""
    p = F.col(score).cast("double")
    rows.select(F.monotonically_increasing_id().alias("number"), name, phred(p).alias("phred"), p.alias("p"), (1 - p).alias("q"), label, predicted).write.csv(path, sep="\t")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Name and score; ``ord`` rises with the file's name and the place in the file, so the last of repeated names can win.

    A task's rows keep the order they have in its range of a file; ranges are numbered by file and first byte.
    """
    rows = spark.read.schema(schemas.SCORES).csv(path, sep="\t")
    rows = rows.withColumns({"_file": F.col("_metadata.file_path"), "_from": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    # one row for each range of a file
    ranges = rows.groupBy("_file", "_from").agg(F.min("_row").alias("_first"))
    ranges = ranges.withColumn("_range", F.row_number().over(Window.orderBy("_file", "_from")))
    at = F.shiftleft(F.col("_range").cast("bigint"), 33) + F.col("_row") - F.col("_first")
    return rows.join(F.broadcast(ranges), ["_file", "_from"]).select("read_name", "mapq_new", at.alias("ord"))


def append_stats(row: DataFrame, path: str) -> None:
    row.write.mode("append").csv(path, sep="\t")


def fasta_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """Name, length, offset, bases and bytes of a line for each sequence; read from ``path``.fai, which is built and saved where it is missing."""
    at = Path(f"{path}.fai")
    if not at.exists():
        rows, offset = [], 0
        with open(path, "rb") as f:
            for line in f:
                size = len(line)
                if line.startswith(b">"):
                    rows.append([line[1:].split()[0].decode(), 0, offset + size, 0, 0])
                elif rows and line.strip():
                    bases = len(line.rstrip(b"\r\n"))
                    rows[-1][1] += bases
                    if not rows[-1][3]:
                        rows[-1][3:] = [bases, size]
                offset += size
        at.write_text("".join("\t".join(map(str, r)) + "\n" for r in rows))
    return [(n, *map(int, rest)) for n, *rest in (line.split("\t") for line in at.read_text().splitlines() if line)]


def read_genome(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """``contig_idx``, ``name``, ``chunk_no`` and ``seq``: each task seeks to its chunks of the shared FASTA file by the index."""
    index = fasta_index(path)
    rows = [(i, *r) for i, r in enumerate(index)]
    plan = spark.createDataFrame(rows, "contig_idx int, name string, length bigint, at bigint, bases int, width int")
    last = F.greatest(F.floor((F.col("length") - 1) / chunk), F.lit(0))
    plan = plan.where("length > 0").withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    plan = plan.repartition(max(1, min(1000, sum(-(-r[1] // chunk) for r in index))), "contig_idx", "chunk_no")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(path, "rb") as f:
            for pdf in frames:
                seqs = []
                for r in pdf.itertuples():
                    a, b = r.chunk_no * chunk, min((r.chunk_no + 1) * chunk, r.length)
                    start = r.at + a // r.bases * r.width + a % r.bases
                    stop = r.at + (b - 1) // r.bases * r.width + (b - 1) % r.bases + 1
                    f.seek(start)
                    seqs.append(f.read(stop - start).replace(b"\n", b"").replace(b"\r", b"").decode("ascii").upper())
                yield pdf[["contig_idx", "name", "chunk_no"]].assign(seq=seqs)

    return plan.mapInPandas(run, "contig_idx int, name string, chunk_no bigint, seq string")


def read_fastq(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``name``, ``seq`` and ``qual``; a task for each file, as compressed files can't be split. Files must be on a shared path."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for path in pdf["path"]:
                with (gzip.open if path.endswith(".gz") else open)(path, "rt") as f:
                    rows = []
                    while head := f.readline():
                        seq, _, qual = f.readline().strip(), f.readline(), f.readline().strip()
                        rows.append((head[1:].split()[0] if head[1:].split() else "", seq, qual))
                        if len(rows) >= 10_000:
                            yield pd.DataFrame(rows, columns=["name", "seq", "qual"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["name", "seq", "qual"])

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths)).mapInPandas(run, "name string, seq string, qual string")


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """Contigs of a FASTA index, in its order."""
    rows = [(i, n, length) for i, (n, length, *_) in enumerate(fasta_index(path.removesuffix(".fai")))]
    return spark.createDataFrame(rows, schemas.CONTIGS)
