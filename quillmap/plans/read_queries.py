"""Queries over the alignment records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmap.functions import reads as R
from quillmap.functions import sequences as S
from quillmap.operators import features, intervals, recalibrate, sampling
from quillmap.sources.tables import table


def _reads(spark, d):
    return table(spark, d, "reads")


# SQL pieces; quality strings are phred + 33, and '5' is phred 20
USABLE = "FROM reads WHERE NOT coalesce(is_unmapped, false) AND contig_idx IS NOT NULL AND coalesce(as_, 0) <> coalesce(xs, 75)"
LOW = "regexp_replace(coalesce(qual, ''), '[^!-4]', '', 'g')"
LOW_N = f"length({LOW})"
LOW_MEAN = f"CASE WHEN {LOW_N} > 0 THEN list_sum(list_transform(string_split({LOW}, ''), lambda b: ascii(b) - 33))::DOUBLE / {LOW_N} ELSE 40.0 END"
PLACES = """list_filter(list_transform(list_filter(flatten(list_transform(string_split(qname, ':')[1:2], lambda f: string_split(f, ','))),
  lambda p: p <> ''), lambda p: {'chrom': lower(string_split(p, '-')[1]), 'pos': TRY_CAST(string_split(p, '-')[2] AS INTEGER)}), lambda s: s.pos IS NOT NULL)"""
LABEL = f"""CASE WHEN len({PLACES}) > 0 THEN CASE WHEN coalesce(len(list_filter({PLACES}, lambda s: s.chrom = lower(contig) AND abs(s.pos - begin_pos) <= 1)), 0) > 0
  THEN 0 ELSE 1 END END"""
ORIENT = "CASE WHEN is_rc IS NULL OR mate_rc IS NULL THEN NULL WHEN NOT is_rc AND mate_rc THEN 0 WHEN NOT is_rc THEN 1 WHEN mate_rc THEN 2 ELSE 3 END"
TYPE = "CASE WHEN yt IS NULL OR yt = 'CP' THEN 0 WHEN yt = 'DP' THEN 1 WHEN yt = 'UP' THEN 2 WHEN yt = 'UU' THEN 3 END"
VECTOR = f"""ord, read_name, contig_idx AS chromosome_idx, begin_pos + 1 AS read_begin_pos, mapq, CAST(sign(coalesce(tlen, 0)) AS INTEGER) AS insert_size,
  coalesce(xg, 0) AS gap_extensions, coalesce(nm, 0) AS edit_distance, coalesce(xm, 0) AS mismatches, coalesce(xo, 0) AS gap_opens,
  coalesce(as_, 0) AS alignment_score, coalesce(xs, 75) AS secondary_alignment_score, {ORIENT} AS pair_orientation, {TYPE} AS pair_alignment_type,
  CAST({LOW_N} AS INTEGER) AS n_low_qual_bases, {LOW_MEAN} AS avg_low_qual_base_score, coalesce(ys, 0) AS mate_alignment_score,
  coalesce(xs, 75) - coalesce(as_, 0) AS alignment_scores_diff"""
SCORES = "(SELECT read_name, arg_max(coalesce(mapq_new, -1), ord) AS mapq_new FROM scores WHERE read_name IS NOT NULL GROUP BY read_name)"
DRAW = "('0x' || substr(md5({k} || '|{s}'), 1, 8))::UBIGINT"


def draw_sql(key: str, seed: int) -> str:
    return DRAW.format(k=f"CAST({key} AS VARCHAR)", s=seed)


SEEDS = [15, 25, 35, 45, 55, 65, 75, 85, 95, 105, 115, 125, 135, 145]
SHARE = 0.078


def qual_line(spark, d):
    rows = _reads(spark, d).select("ord", S.quality_line("qual").alias("q"))
    return rows.select("ord", *[F.round(f"q.{x}", 6).alias(x) for x in ("intercept", "slope", "r")])


def truth_label(spark, d):
    return features.labelled(_reads(spark, d)).select("ord", "label")


def stratified(spark, d):
    rows = features.labelled(_reads(spark, d)).select("ord", "label")
    return sampling.stratified_split(rows, "label", "ord")


def trace_det(spark, d):
    rows = _reads(spark, d).select("ord", S.sequence_invariants("seq").alias("v"))
    return rows.select("ord", F.round("v.trace", 6).alias("trace"), F.round("v.det", 6).alias("det"))


def pools(spark, d):
    rows = features.labelled(_reads(spark, d)).select("ord", "label", (F.col("mapq") < 20).cast("int").alias("predicted"))
    return sampling.resampled_pools(rows, "label", "predicted", "ord")


#: Letters of a chunk of the stand-in genome.
CHUNK = 1024


def genome(spark, d):
    """A genome for the contigs of the data, which come without one: its letters are the digits of digests of contig, chunk and place.

    Letters are made of the chunks that some read's window touches.
    """
    windows = intervals.reference_windows(features.usable(_reads(spark, d)), table(spark, d, "contigs"))
    touched = F.explode(F.sequence(F.floor(F.col("left") / CHUNK).cast("int"), F.floor((F.col("right") - 1) / CHUNK).cast("int"))).alias("chunk_no")
    chunks = table(spark, d, "contigs").select("contig_idx", "length", F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / CHUNK).cast("int"))).alias("chunk_no"))
    chunks = chunks.join(windows.select("contig_idx", touched).distinct(), ["contig_idx", "chunk_no"], "left_semi")
    letters = F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 32 - 1)), lambda i: F.translate(F.md5(F.concat_ws("|", "contig_idx", "chunk_no", i)), "0123456789abcdef", "ACGT" * 4))
    return chunks.select("contig_idx", "chunk_no", F.substring(F.array_join(letters, ""), F.lit(1), F.least(F.lit(CHUNK), F.col("length") - F.col("chunk_no") * CHUNK).cast("int")).alias("seq"))


def reference_text(spark, d):
    """The reference text of each read's window, and its GC content."""
    windows = intervals.reference_windows(features.usable(_reads(spark, d)), table(spark, d, "contigs"))
    pieces = intervals.reference_pieces(windows, genome(spark, d), CHUNK)
    return pieces.select("ord", F.md5("piece").alias("piece_md5"), F.length("piece").alias("letters"), S.gc_content(F.col("piece")).alias("ref_gc_content"))


def reference_features(spark, d):
    return features.reference_features(_reads(spark, d), table(spark, d, "contigs"), genome(spark, d), CHUNK)


def full_vector(spark, d):
    return features.full_vector(_reads(spark, d), table(spark, d, "contigs"), genome(spark, d), CHUNK)


QUERIES = {
    "reference_text": (
        reference_text,
        f"""WITH w AS (SELECT ord, contig_idx, greatest(begin_pos - 125, 0) AS a, least(begin_pos + length(seq) + 125, c.length) AS b FROM (SELECT ord, contig_idx, begin_pos, seq {USABLE}) JOIN contigs c USING (contig_idx)),
        k AS (SELECT ord, contig_idx, a, b, unnest(range(a // 32, (b - 1) // 32 + 1)) AS i FROM w WHERE b > a),
        t AS (SELECT ord, a, b, string_agg(translate(md5(contig_idx || '|' || (i // {CHUNK // 32}) || '|' || (i % {CHUNK // 32})), '0123456789abcdef', 'ACGTACGTACGTACGT'), '' ORDER BY i) AS s FROM k GROUP BY ALL),
        p AS (SELECT ord, substr(s, CAST(a - a // 32 * 32 + 1 AS BIGINT), CAST(b - a AS BIGINT)) AS piece FROM t)
        SELECT ord, md5(piece) AS piece_md5, CAST(length(piece) AS INTEGER) AS letters, length(regexp_replace(piece, '[^CG]', '', 'g'))::DOUBLE / length(piece) AS ref_gc_content FROM p""",
    ),
    "reference_features": (reference_features, None),
    "full_vector": (full_vector, None),
    "recal_join": (
        lambda s, d: recalibrate.recalibrated(_reads(s, d).select("ord", "read_name", "mapq"), table(s, d, "scores")),
        f"SELECT r.ord, r.read_name, coalesce(nullif(n.mapq_new, -1), r.mapq) AS mapq FROM reads r LEFT JOIN {SCORES} n USING (read_name)",
    ),
    "recal_mapq_hist": (
        lambda s, d: recalibrate.mapq_before_after(_reads(s, d), table(s, d, "scores")),
        f"""WITH j AS (SELECT r.mapq, coalesce(nullif(n.mapq_new, -1), r.mapq) AS m2 FROM reads r LEFT JOIN {SCORES} n USING (read_name))
        SELECT 'before' AS stage, mapq, count(*) AS n FROM j GROUP BY mapq UNION ALL SELECT 'after', m2, count(*) FROM j GROUP BY m2""",
    ),
    "feature_vector": (lambda s, d: features.feature_vector(_reads(s, d)), f"SELECT {VECTOR}, {LABEL} AS class_code {USABLE}"),
    "feature_subset": (
        lambda s, d: features.feature_vector(_reads(s, d), ["mapq", "alignment_score", "edit_distance"]),
        f"SELECT ord, read_name, mapq, coalesce(as_, 0) AS alignment_score, coalesce(nm, 0) AS edit_distance {USABLE}",
    ),
    "feature_vector_compat": (
        lambda s, d: features.lagged_features(_reads(s, d)),
        f"""SELECT ord, contig_idx, coalesce(lag(n) OVER w, 0) AS n_low_qual_bases, coalesce(lag(m) OVER w, 0) AS avg_low_qual_base_score
        FROM (SELECT ord, contig_idx, begin_pos, CAST({LOW_N} AS INTEGER) AS n, {LOW_MEAN} AS m {USABLE}) WINDOW w AS (PARTITION BY contig_idx ORDER BY begin_pos, ord)""",
    ),
    "sequence_features": (lambda s, d: features.sequence_features(_reads(s, d)), None),
    "pair_orientation": (
        lambda s, d: _reads(s, d).groupBy(R.pair_orientation().alias("pair_orientation")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT {ORIENT} AS pair_orientation, count(*) AS n FROM reads GROUP BY 1",
    ),
    "pair_align_type": (
        lambda s, d: _reads(s, d).groupBy(R.pair_alignment_type().alias("pair_alignment_type")).agg(F.count(F.lit(1)).alias("n")),
        f"SELECT {TYPE} AS pair_alignment_type, count(*) AS n FROM reads GROUP BY 1",
    ),
    "insert_sign": (
        lambda s, d: _reads(s, d).groupBy(R.insert_sign().alias("insert_size")).agg(F.count(F.lit(1)).alias("n")),
        "SELECT CAST(sign(coalesce(tlen, 0)) AS INTEGER) AS insert_size, count(*) AS n FROM reads GROUP BY 1",
    ),
    "multimap_filter": (
        lambda s, d: features.usable(_reads(s, d)).select("ord", "read_name"),
        f"SELECT ord, read_name {USABLE}",
    ),
    "read_counters": (
        lambda s, d: features.read_counters(_reads(s, d)),
        f"""SELECT count(*) AS reads, count(*) FILTER (NOT m) AS unmapped, count(*) FILTER (m AND u) AS multi_mapped,
        count(*) FILTER (m AND NOT u AND label = 1) AS misaligned, count(*) FILTER (m AND NOT u AND label = 0) AS well_aligned
        FROM (SELECT NOT coalesce(is_unmapped, false) AND contig_idx IS NOT NULL AS m, coalesce(as_, 0) = coalesce(xs, 75) AS u, {LABEL} AS label FROM reads)""",
    ),
    "bad_read_ratio": (
        lambda s, d: features.bad_read_ratio(_reads(s, d)),
        f"SELECT count(*) FILTER (label = 1)::DOUBLE / nullif(count(*) FILTER (label = 0), 0) AS ratio FROM (SELECT {LABEL} AS label {USABLE})",
    ),
    "mapq_histogram": (
        lambda s, d: features.mapq_histogram(_reads(s, d)),
        f"SELECT mapq, count(*)::DOUBLE / sum(count(*)) OVER () AS probability FROM (SELECT mapq, {LABEL} AS label {USABLE}) WHERE label = 0 GROUP BY mapq",
    ),
    "region_counts": (
        lambda s, d: features.region_counts(_reads(s, d)),
        "SELECT contig_idx, CAST(floor(begin_pos / 1000000) AS BIGINT) AS region, count(*) AS reads FROM reads WHERE NOT coalesce(is_unmapped, false) AND contig_idx IS NOT NULL GROUP BY ALL",
    ),
    "training_sequences": (
        lambda s, d: features.usable(_reads(s, d)).where("contig_idx > 0").select("ord", "seq"),
        f"SELECT ord, seq {USABLE} AND contig_idx > 0",
    ),
    "truth_label": (truth_label, f"SELECT ord, {LABEL} AS label {USABLE}"),
    "low_quality_bases": (
        lambda s, d: _reads(s, d).select("ord", R.low_quality_count().alias("n_low_qual_bases"), R.low_quality_mean().alias("avg_low_qual_base_score")),
        f"SELECT ord, CAST({LOW_N} AS INTEGER) AS n_low_qual_bases, {LOW_MEAN} AS avg_low_qual_base_score FROM reads",
    ),
    "qual_lsq": (
        qual_line,
        """WITH b AS (SELECT ord, i, ascii(substr(qual, i, 1)) - 33 AS y FROM (SELECT ord, qual, unnest(range(1, length(qual) + 1)) AS i FROM reads WHERE length(qual) > 1)),
        g AS (SELECT ord, regr_intercept(y, i) AS a, regr_slope(y, i) AS s, CASE WHEN var_pop(y) > 0 THEN corr(y, i) END AS r FROM b GROUP BY ord)
        SELECT reads.ord, round(a, 6) AS intercept, round(s, 6) AS slope, round(r, 6) AS r FROM reads LEFT JOIN g USING (ord)""",
    ),
    "gc_content": (
        lambda s, d: _reads(s, d).select("ord", S.gc_content(F.col("seq")).alias("gc"), S.gc_content_without_n(F.col("seq")).alias("gc_no_n")),
        """SELECT ord, length(regexp_replace(upper(seq), '[^CG]', '', 'g'))::DOUBLE / nullif(length(seq), 0) AS gc,
        length(regexp_replace(upper(seq), '[^CG]', '', 'g'))::DOUBLE / nullif(length(replace(upper(seq), 'N', '')), 0) AS gc_no_n FROM reads""",
    ),
    "complexity_zlib": (lambda s, d: _reads(s, d).select("ord", S.zlib_length(6)("seq").alias("zlib_6"), S.zlib_length(9, False)("seq").alias("zlib_9")), None),
    "pair_distance_matrix": (
        lambda s, d: _reads(s, d).select("ord", F.posexplode(S.distance_matrix("seq")).alias("cell", "distance")).select("ord", "cell", F.round("distance", 6).alias("distance")),
        """WITH p AS (SELECT ord, i, position(substr(seq, i, 1) IN 'ACGT') - 1 AS b FROM (SELECT ord, upper(seq) AS seq, unnest(range(1, length(seq) + 1)) AS i FROM reads)),
        g AS (SELECT a.ord, a.b * 4 + c.b AS cell, avg(abs(a.i - c.i)) AS distance FROM p a JOIN p c ON a.ord = c.ord WHERE a.b >= 0 AND c.b >= 0 GROUP BY ALL),
        k AS (SELECT ord, unnest(range(16)) AS cell FROM reads WHERE length(seq) > 0)
        SELECT k.ord, CAST(k.cell AS INTEGER) AS cell, round(coalesce(g.distance, 0), 6) AS distance FROM k LEFT JOIN g ON g.ord = k.ord AND g.cell = k.cell""",
    ),
    "seq_invariants": (lambda s, d: _reads(s, d).select("ord", S.sequence_invariants("seq").alias("v")).select("ord", "v.*"), None),
    "seq_trace_det": (
        trace_det,
        f"""WITH p AS (SELECT ord, i, position(substr(seq, i, 1) IN 'ACGT') - 1 AS b FROM (SELECT ord, upper(seq) AS seq, unnest(range(1, length(seq) + 1)) AS i FROM reads)),
        g AS (SELECT a.ord, a.b AS r, c.b AS c, avg(abs(a.i - c.i)) AS x FROM p a JOIN p c ON a.ord = c.ord WHERE a.b >= 0 AND c.b >= 0 GROUP BY ALL),
        s AS (SELECT ord, min(x) AS low, nullif(max(x) - min(x), 0) AS wide, sqrt(count(*)) AS k FROM g GROUP BY ord HAVING count(*) > 1),
        m AS (SELECT s.ord, any_value(k) AS k, {", ".join(f"coalesce(max((x - low) / wide) FILTER (r = {a} AND c = {b}), {int(a == b)}) AS m{a}{b}" for a in range(4) for b in range(4))}
          FROM s JOIN g USING (ord) WHERE wide IS NOT NULL GROUP BY s.ord),
        d AS (SELECT ord, m00 + m11 + m22 + m33 - (4 - k) AS t,
          (m00 * m11 - m10 * m01) * (m22 * m33 - m32 * m23) - (m00 * m12 - m10 * m02) * (m21 * m33 - m31 * m23) + (m00 * m13 - m10 * m03) * (m21 * m32 - m31 * m22)
          + (m01 * m12 - m11 * m02) * (m20 * m33 - m30 * m23) - (m01 * m13 - m11 * m03) * (m20 * m32 - m30 * m22) + (m02 * m13 - m12 * m03) * (m20 * m31 - m30 * m21) AS det FROM m)
        SELECT reads.ord, round(t, 6) AS trace, round(det, 6) AS det FROM reads LEFT JOIN d USING (ord)""",
    ),
    "balanced_sample": (
        lambda s, d: sampling.balanced_reads(_reads(s, d)).select("ord", "label"),
        f"""WITH l AS (SELECT ord, {LABEL} AS label {USABLE}),
        r AS (SELECT least(1, count(*) FILTER (label = 1)::DOUBLE / nullif(count(*) FILTER (label = 0), 0)) AS ratio FROM l)
        SELECT ord, label FROM l, r WHERE label = 1 OR (label = 0 AND {draw_sql("ord", 1)} < ratio * 4294967296)""",
    ),
    "downsample_replicates": (
        lambda s, d: sampling.replicates(_reads(s, d).select("ord", "qname"), SEEDS, SHARE).select("ord", "replicate"),
        " UNION ALL ".join(f"SELECT ord, {x} AS replicate FROM reads WHERE {draw_sql('qname', x)} < {SHARE} * 4294967296" for x in SEEDS),
    ),
    "stratified_split": (
        stratified,
        f"""WITH l AS (SELECT ord, {LABEL} AS label {USABLE})
        SELECT ord, label, row_number() OVER (PARTITION BY label ORDER BY {draw_sql("ord", 1)}, ord) <= floor(count(*) OVER (PARTITION BY label) * 0.2) AS is_train FROM l WHERE label IS NOT NULL""",
    ),
    "undersample": (
        lambda s, d: sampling.undersampled(features.labelled(_reads(s, d)).select("ord", "label"), "label", "ord"),
        f"""WITH l AS (SELECT ord, {LABEL} AS label {USABLE}), n AS (SELECT label, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY label)
        SELECT ord, label FROM l WHERE label IS NOT NULL QUALIFY row_number() OVER (PARTITION BY label ORDER BY {draw_sql("ord", 1)}, ord) <= (SELECT min(n) FROM n)""",
    ),
    "resample_pools": (
        pools,
        f"""WITH l AS (SELECT ord, CASE WHEN label = 1 THEN CASE WHEN mapq < 20 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN mapq < 20 THEN 'FP' ELSE 'TN' END END AS pool
          FROM (SELECT ord, mapq, {LABEL} AS label {USABLE}) WHERE label IS NOT NULL AND mapq IS NOT NULL),
        r AS (SELECT ord, pool, row_number() OVER (PARTITION BY pool ORDER BY {draw_sql("ord", 1)}, ord) - 1 AS number FROM l),
        s AS (SELECT pool, count(*) AS n, (SELECT count(*) FROM l WHERE pool = 'FP') AS fp FROM l GROUP BY pool),
        d AS (SELECT pool, n, unnest(range(1, 1 + CASE WHEN pool IN ('FN', 'TN') THEN 1 WHEN fp = 0 THEN 0 WHEN pool = 'FP' THEN fp - 1 ELSE fp * 2 - 1 END)) AS draw_no FROM s),
        x AS (SELECT pool, CAST(draw_no AS INTEGER) AS draw_no, CAST({draw_sql("pool || '|' || draw_no", 1)} % n AS BIGINT) AS number FROM d)
        SELECT pool, draw_no, ord FROM x JOIN r USING (pool, number)""",
    ),
}
