"""Command line: features, recal and samplebam over alignment files, or over parquet where paths end so."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.operators import features, recalibrate, sampling
from quillmap.functions.reads import FEATURES as READ_FEATURES
from quillmap.session import ship
from quillmap.sources import bam, text_files


def load_reads(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".sam"):
        return text_files.read_sam(spark, path)
    if path.rstrip("/").endswith(".bam"):
        bam.register(spark)
        return spark.read.format("bam").load(path)
    return spark.read.parquet(path)


def source_header(spark: SparkSession, path: str) -> list[str] | None:
    """The header's lines of an alignment file; None for parquet."""
    if path.rstrip("/").endswith(".sam"):
        return text_files.sam_header(spark, path)
    return bam.header_text(path).splitlines() if path.rstrip("/").endswith(".bam") else None


def save_reads(reads: DataFrame, contigs: DataFrame | None, path: str, header: list[str] | None = None) -> None:
    """Writes in the format that the path's ending names, with the header of the source where it has one."""
    if path.rstrip("/").endswith(".sam"):
        text_files.write_sam(reads, contigs, path, header)
    elif path.rstrip("/").endswith(".bam"):
        bam.register(reads.sparkSession)
        if contigs is not None:
            names = ",".join(f"{r.name}:{r.length}" for r in contigs.orderBy("contig_idx").collect())
        else:
            fields = [dict(p.split(":", 1) for p in x.split("\t")[1:]) for x in header or [] if x.startswith("@SQ")]
            names = ",".join(f"{f['SN']}:{f['LN']}" for f in fields)
        out = reads.orderBy("ord").write.format("bam").option("contigs", names).mode("append")
        (out.option("header", "\n".join(header) + "\n") if header else out).save(path)
    else:
        reads.write.parquet(path)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillmap", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("features", "write the feature table"), ("recal", "replace mapping qualities by scores"), ("samplebam", "write a sample balanced by origin labels")):
        c = sub.add_parser(name, help=text)
        c.add_argument("--reads", required=True)
        c.add_argument("--out", required=True)
        c.add_argument("--contigs", help="parquet of contigs, or a FASTA index")
        if name == "features":
            c.add_argument("--features", help="comma-separated names; all by default")
            c.add_argument("--genome", help="FASTA with an index, for the features of the reference window")
        if name == "recal":
            c.add_argument("--scores", required=True, help="tab-separated names and scores")
        if name == "samplebam":
            c.add_argument("--seed", type=int, default=1)
    return p


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    o = parser().parse_args(args)
    spark = spark or SparkSession.builder.appName("quillmap").getOrCreate()
    ship(spark)
    contigs = None
    if o.contigs:
        contigs = text_files.read_fai(spark, o.contigs) if o.contigs.endswith(".fai") else spark.read.parquet(o.contigs)
    reads = load_reads(spark, o.reads)
    if o.command == "features":
        names = o.features.split(",") if o.features else None
        if names and set(names) <= set(READ_FEATURES):
            # a projection of the reads alone
            text_files.write_features(features.feature_vector(reads, names), o.out)
        else:
            chunk = 1 << 20
            genome = text_files.read_genome(spark, o.genome, chunk) if o.genome else None
            rows = features.full_vector(reads, contigs if contigs is not None else text_files.read_fai(spark, f"{o.genome}.fai") if o.genome else None, genome, chunk)
            text_files.write_features(rows.select("read_name", *names) if names else rows, o.out)
    elif o.command == "recal":
        save_reads(recalibrate.recalibrated(reads, text_files.read_scores(spark, o.scores)), contigs, o.out, source_header(spark, o.reads))
    else:
        save_reads(sampling.balanced_reads(reads, o.seed).drop("label"), contigs, o.out, source_header(spark, o.reads))


if __name__ == "__main__":
    main()
