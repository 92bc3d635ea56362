"""Schemas of the domain tables."""

from __future__ import annotations

READS = (
    "ord bigint, read_name string, qname string, is_first boolean, is_rc boolean, mate_rc boolean, is_unmapped boolean, contig_idx int, contig string, begin_pos int, "
    "mapq int, tlen int, seq string, qual string, as_ int, xs int, ys int, xg int, nm int, xm int, xo int, yt string, tags map<string,string>, "
    "tag_types map<string,string>, flag int, cigar string, mate_contig string, mate_pos int, record binary"
)
CONTIGS = "contig_idx int, name string, length int"
SCORES = "read_name string, mapq_new int"
VARIANTS = "chrom string, pos int, id string, ref_allele string, alt_allele string, qual string, filter string, info string"

#: The feature file's columns after the read name, in file order.
FEATURE_FILE = [
    "chromosome_idx", "read_begin_pos", "mapq", "insert_size", "gap_extensions", "edit_distance", "mismatches", "gap_opens", "alignment_score", "secondary_alignment_score",
    "read_complexity_score", "read_gc_content", "pair_orientation", "pair_alignment_type", "qual_intercept", "qual_slope", "qual_r_value", "read_depth", "read_eigenval_1",
    "read_eigenval_2", "read_trace", "read_det", "ref_eigenval_1", "ref_eigenval_2", "ref_trace", "ref_det", "ref_complexity_score", "ref_gc_content", "n_low_qual_bases",
    "avg_low_qual_base_score", "mate_alignment_score", "alignment_scores_diff", "class_code",
]
