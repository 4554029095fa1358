"""Schemas of the tables that operators take and give."""

from __future__ import annotations

READS = "read_id long, sample_idx int, tn string, qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, seq string, qual array<int>, tags map<string,string>"
REFERENCE = "chrom string, chunk_start int, bases string"
DBSNP = "chrom string, pos int, rs int, mask tinyint"
TRANSCRIPTS = "gene string, name string, chrom string, strand string, cds_start int, cds_end int, exon_starts array<int>, exon_ends array<int>"
MATRIX = "sample_id string, col int, value tinyint"

# SAM flag bits, as the SAM specification numbers them.
PAIRED, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, SECONDARY, DUPLICATE = 0x1, 0x4, 0x8, 0x10, 0x20, 0x40, 0x100, 0x400
