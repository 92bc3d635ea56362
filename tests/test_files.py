"""Round trips through every file format."""

import gzip
import random
import struct

import pytest

from quillmap import cli
from quillmap.sources import bam, text_files
from quillmap.sources.tables import table
from quillmap.streaming import arrivals

SF = "/root/testdata/sf0.001"
SHARED = ["read_name", "qname", "is_first", "is_rc", "mate_rc", "is_unmapped", "contig_idx", "contig", "begin_pos", "mapq", "tlen", "seq", "qual", "as_", "xs", "ys", "xg", "nm", "xm", "xo", "yt"]


@pytest.fixture(scope="module")
def reads(spark):
    # flags and numbers of these formats can't be missing
    return table(spark, SF, "reads").fillna(False, ["is_first", "is_rc", "mate_rc", "is_unmapped"]).fillna(0, ["tlen", "mapq"])


def rows(df):
    return sorted(map(str, df.select(SHARED).collect()))


def test_sam(spark, reads, tmp_path):
    p = str(tmp_path / "x.sam")
    text_files.write_sam(reads, table(spark, SF, "contigs"), p)
    back = text_files.read_sam(spark, p)
    assert rows(back) == rows(reads)
    order = [r["read_name"] for r in back.orderBy("ord").collect()]
    assert order == [r["read_name"] for r in reads.orderBy("ord").collect()]


def test_bam(spark, reads, tmp_path):
    bam.register(spark)
    p = tmp_path / "x.bam"
    names = ",".join(f"{r['name']}:{r['length']}" for r in table(spark, SF, "contigs").orderBy("contig_idx").collect())
    order = reads.orderBy("contig_idx", "begin_pos", "ord").coalesce(1)
    order.write.format("bam").option("contigs", names).mode("append").save(str(p))
    back = spark.read.format("bam").load(str(p))
    assert rows(back) == rows(reads)
    only = spark.read.format("bam").option("contig", 2).load(str(p))
    assert rows(only) == rows(reads.where("contig_idx = 2"))
    for f in p.glob("*.bam"):
        bam.index_file(str(f))
    indexed = spark.read.format("bam").load(str(p))
    assert rows(indexed.where("contig_idx IS NOT NULL")) == rows(reads.where("contig_idx IS NOT NULL"))
    assert rows(spark.read.format("bam").option("contig", 2).load(str(p))) == rows(reads.where("contig_idx = 2"))
    assert bam.BamReader({"path": str(p), "contig": "2"}).partitions()[0].contig == 2


def test_vcf(spark, tmp_path):
    calls = spark.createDataFrame([("chr1", 5, "A", "C", 20.5), ("chr1", 7, "AT", "T", None), ("chr2", 1, "G", "A,T", 3.0)], "chrom string, pos int, ref_allele string, alt_allele string, qual double")
    text_files.write_vcf(calls, str(tmp_path / "v"))
    back = text_files.read_vcf(spark, str(tmp_path / "v")).orderBy("chrom", "pos").collect()
    assert [(r["chrom"], r["pos"], r["qual"], r["is_snp"]) for r in back] == [("chr1", 5, 20.5, True), ("chr1", 7, None, False), ("chr2", 1, 3.0, True)]


def test_tables(spark, tmp_path):
    f = spark.createDataFrame([("a/1", 3.0, 1), ("b/2", None, 0)], "read_name string, mapq double, class_code int")
    text_files.write_features(f, str(tmp_path / "f"))
    back = text_files.read_features(spark, str(tmp_path / "f"), ["mapq", "class_code"])
    assert sorted(map(tuple, back.collect())) == [("a/1", 3.0, 1.0), ("b/2", None, 0.0)]
    s = spark.createDataFrame([("a/1", 7)], "read_name string, mapq_new int")
    text_files.write_scores(s, str(tmp_path / "s"))
    assert [(r["read_name"], r["mapq_new"]) for r in text_files.read_scores(spark, str(tmp_path / "s")).collect()] == [("a/1", 7)]
    wide = spark.createDataFrame([("a/1", 0.01, 0, 0), ("b/2", None, 1, 0)], "read_name string, score double, label int, predicted int")
    text_files.write_wide_scores(wide, str(tmp_path / "w"))
    assert sorted((r[1], r[2]) for r in spark.read.csv(str(tmp_path / "w"), sep="\t").collect()) == [("a/1", "19"), ("b/2", None)]
    for _ in range(2):
        text_files.append_stats(s, str(tmp_path / "stats"))
    assert spark.read.csv(str(tmp_path / "stats"), sep="\t").count() == 2


def test_genome_and_fastq(spark, tmp_path):
    fa = tmp_path / "g.fa"
    one, two = "ACGTTGCAAC" * 13, "GGC"
    fa.write_text(">c1 first\n" + "\n".join(one[i : i + 60] for i in range(0, len(one), 60)) + "\n>c2\n" + two + "\n>c3\n")
    got = text_files.read_genome(spark, str(fa), 50).orderBy("contig_idx", "chunk_no").collect()
    assert "".join(r["seq"] for r in got if r["name"] == "c1") == one and [r["seq"] for r in got if r["name"] == "c2"] == [two]
    assert [(r["name"], r["length"]) for r in text_files.read_fai(spark, f"{fa}.fai").orderBy("contig_idx").collect()] == [("c1", 130), ("c2", 3), ("c3", 0)]
    with gzip.open(tmp_path / "r.fastq.gz", "wt") as f:
        f.write("@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n")
    back = text_files.read_fastq(spark, [str(tmp_path / "r.fastq.gz")]).orderBy("name").collect()
    assert [tuple(r) for r in back] == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]


def test_command_line(spark, tmp_path):
    contigs = f"{SF}/contigs.parquet"
    cli.main(["features", "--reads", f"{SF}/reads.parquet", "--out", str(tmp_path / "f"), "--features", "mapq,edit_distance"], spark)
    assert spark.read.csv(str(tmp_path / "f"), sep="\t").count() > 500
    cli.main(["features", "--reads", f"{SF}/reads.parquet", "--out", str(tmp_path / "all")], spark)
    whole = text_files.read_features(spark, str(tmp_path / "all"))
    # without a genome only the columns of the reference window are 0
    empty = {c for c in whole.columns[1:] if whole.where(f"{c} <> 0").isEmpty()}
    assert {c for c in empty if not c.startswith("ref_")} <= {"gap_opens", "gap_extensions"} and len([c for c in empty if c.startswith("ref_")]) == 6
    scores = tmp_path / "scores.tsv"
    name = table(spark, SF, "reads").first()["read_name"]
    scores.write_text(f"{name}\t3\n{name}\t77\n")
    cli.main(["recal", "--reads", f"{SF}/reads.parquet", "--out", str(tmp_path / "r.sam"), "--scores", str(scores), "--contigs", contigs], spark)
    back = text_files.read_sam(spark, str(tmp_path / "r.sam"))
    assert back.count() == table(spark, SF, "reads").count()
    assert {r["mapq"] for r in back.where(back.read_name == name).collect()} == {77}
    cli.main(["samplebam", "--reads", f"{SF}/reads.parquet", "--out", str(tmp_path / "s.bam"), "--contigs", contigs], spark)
    assert 0 < cli.load_reads(spark, str(tmp_path / "s.bam")).count() < back.count()


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    reads = table(spark, SF, "reads")
    reads.write.parquet(str(src))
    stream = spark.readStream.schema(reads.schema).parquet(str(src))
    scores = table(spark, SF, "scores")
    out = arrivals.recalibrated_stream(arrivals.first_deliveries(stream, "90 days"), scores)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == reads.select("read_name").distinct().count()
    q = arrivals.arrival_counts(stream, "1 day", "90 days").writeStream.format("memory").queryName("arrived").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("SELECT sum(reads) FROM arrived").first()[0] == reads.where("arrived_at IS NOT NULL").count()


def alignments(n=3000):
    """Records of a sorted file with gaps, secondary and supplementary ones, mates elsewhere and tags of every type."""
    rng, out = random.Random(8), []
    for i in range(n):
        contig = i * 2 // n
        name = f"r{rng.randint(0, 999)}".encode() + b"\0"
        steps = [(50, 0), (1, 2), (50, 0)] if i % 3 else [(10, 4), (90, 0)]
        cigar = b"".join(struct.pack("<I", a << 4 | b) for a, b in steps)
        flag = 1 | rng.choice([0x40, 0x80]) | rng.choice([0, 0x100, 0x200, 0x400, 0x800, 0x8])
        tags = b"NMC" + bytes([i % 200]) + b"ASs" + struct.pack("<h", -5) + b"RGZone\0" + b"XAAq" + b"ZBBs" + struct.pack("<i2h", 2, -3, i % 99) + b"ZFf" + struct.pack("<f", 0.5)
        pos = (i % (n // 2)) * 30
        head = struct.pack("<iiBBHHHiiii", contig, pos, len(name), rng.randint(0, 60), 4681, len(steps), flag, 100, 1 - contig, i, 350)
        out.append(head + name + cigar + bytes(rng.randint(0, 255) & 0x77 | 0x11 for _ in range(50)) + bytes(rng.randint(0, 40) for _ in range(100)) + tags)
    return out


TEXT = "@HD\tVN:1.6\tSO:coordinate\n@SQ\tSN:c1\tLN:100000\n@SQ\tSN:c2\tLN:90000\n@RG\tID:one\tSM:x\n@PG\tID:map\tPN:any\n"


@pytest.fixture(scope="module")
def alignment_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("bam") / "in.bam"
    text = TEXT.encode()
    data = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", 2) + b"".join(struct.pack("<i", 3) + n + b"\0" + struct.pack("<i", x) for n, x in ((b"c1", 100000), (b"c2", 90000)))
    data += b"".join(struct.pack("<i", len(r)) + r for r in alignments())
    path.write_bytes(b"".join(bam._block(data[a : a + 9000]) for a in range(0, len(data), 9000)) + bam.LAST_BLOCK)
    return str(path)


def raw_records(path):
    blocks, out = bam.Blocks(path), []
    bam.header(blocks)
    while len(size := blocks.read(4)) == 4:
        out.append(blocks.read(struct.unpack("<i", size)[0]))
    return out


def test_bam_is_read_in_pieces(spark, alignment_file):
    """Without an index one file is many tasks, none of which loses or repeats a record; a range of places is pruned."""
    bam.register(spark)
    df = spark.read.format("bam").option("split", 20_000).load(alignment_file)
    assert len(bam.BamReader({"path": alignment_file, "split": "20000"}).partitions()) > 8
    assert [bytes(r["record"]) for r in df.orderBy("ord").collect()] == alignments()
    first = df.orderBy("ord").first()
    assert first["cigar"] == "10S90M" and first["mate_contig"] == "c2" and first["mate_pos"] == 0 and first["tags"]["ZB"] == "-3,0" and first["tag_types"]["ZB"] == "Bs"
    for index in (False, True):
        if index:
            bam.index_file(alignment_file)
        got = spark.read.format("bam").option("contig", 1).option("begin", 20_000).option("end", 30_000).option("split", 20_000).load(alignment_file)
        want = [r for r in alignments() if struct.unpack_from("<ii", r)[0] == 1 and 20_000 <= struct.unpack_from("<ii", r)[1] < 30_000]
        assert [bytes(r["record"]) for r in got.orderBy("ord").collect()] == want
    assert spark.read.format("bam").option("split", 20_000).load(alignment_file).count() == 3000


def test_recalibration_changes_nothing_else(spark, alignment_file, tmp_path):
    """Records are byte-equal but for the mapping quality, the header's text is kept; so are SAM lines."""
    scores = tmp_path / "s.tsv"
    scores.write_text("".join(f"r{i}/{m}\t{i % 60}\n" for i in range(500) for m in (1, 2)))
    out = tmp_path / "out.bam"
    cli.main(["recal", "--reads", alignment_file, "--out", str(out), "--scores", str(scores)], spark)
    assert bam.header_text(str(out)) == TEXT
    back = [r for f in bam.files(str(out)) for r in raw_records(f)]
    want = alignments()
    assert sorted(r[:9] + r[10:] for r in back) == sorted(r[:9] + r[10:] for r in want)
    by = {r[:9] + r[10:]: r[9] for r in back}
    for r in want:
        name = int(r[32 : 32 + r[8] - 1][1:])
        assert by[r[:9] + r[10:]] == (name % 60 if name < 500 else r[9])
    sam = tmp_path / "x.sam"
    cli.main(["recal", "--reads", alignment_file, "--out", str(sam), "--scores", str(scores)], spark)
    lines = [r["value"] for r in spark.read.text(str(sam)).collect()]
    assert [x for x in lines if x.startswith("@")] == TEXT.splitlines()
    f = next(x for x in lines if "10S90M" in x).split("\t")
    assert f[5] == "10S90M" and f[6] == "c2" and f[7] == "1" and {"AS:i:-5", "RG:Z:one", "XA:A:q", "ZF:f:0.5", "ZB:B:s,-3,0"} <= set(f[11:])
    again = tmp_path / "y.sam"
    cli.main(["recal", "--reads", str(sam), "--out", str(again), "--scores", str(scores)], spark)
    assert sorted(r["value"] for r in spark.read.text(str(again)).collect()) == sorted(lines)
    # and from text to binary
    third = tmp_path / "z.bam"
    cli.main(["recal", "--reads", str(sam), "--out", str(third), "--scores", str(scores)], spark)
    kept = spark.read.format("bam").load(str(third)).select("qname", "flag", "cigar", "mate_contig", "mate_pos", "mapq", "tags")
    assert sorted(map(str, kept.collect())) == sorted(map(str, spark.read.format("bam").load(str(out)).select(*kept.columns).collect()))


def test_scores_last_wins_over_files(spark, tmp_path):
    (tmp_path / "s").mkdir()
    (tmp_path / "s/b.tsv").write_text("x/1\t3\n" + "y/1\t4\n" * 50 + "x/1\t5\n")
    (tmp_path / "s/a.tsv").write_text("x/1\t9\n" * 10)
    got = text_files.read_scores(spark, str(tmp_path / "s")).orderBy("ord").collect()
    assert [r["mapq_new"] for r in got] == [9] * 10 + [3] + [4] * 50 + [5]
