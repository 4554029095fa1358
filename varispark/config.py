"""Settings of the variant caller and of matrix analysis."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class VariantConfig:
    """Thresholds of variant calling; the defaults are those of the reported results."""

    min_score: float = 0.0
    min_quality: int = 10
    min_minor_allele_frequency: float = 0.05
    min_alt_allele_count: int = 3
    min_coverage: int = 4
    min_alt_count_for_filters: int = 6
    min_alt_reads_with_flank: int = 1
    alt_flank_window: int = 10
    min_unique_read_names: int = 1
    min_unique_starts: int = 2
    mismapped_deletion_distance: int = 10
    mate_disagreement_tolerated: int = 1
    min_flanking_quality: int = 15
    flanking_window: int = 5
    min_mapq: int = 1
    skip_non_primary: bool = True
    mismatch_max_hq: int = 3
    mismatch_hq_quality: int = 15
    mismatch_max_lq: int = 6
    mismatch_lq_quality: int = 3
    end_mismatch_windows: tuple[tuple[int, int], ...] = ((10, 3), (6, 2))
    broad_min_quality: int = 15
    mismap_frequency: float = 0.5
    poly_x_min_repeats: int = 8
    poly_x_indel_max_length: int = 1
    skew_call_coverage: int = 10
    skew_call_variants: int = 3
    skew_filter_coverage: int = 20
    skew_filter_variants: int = 6
    skew_share: float = 0.95
    fishers_exact: bool = False
    fishers_cutoff: float = 0.10
    prior_poly: float = 0.001
    flank_text: int = 20


@dataclass(frozen=True)
class MatrixConfig:
    """Limits of sample-by-marker matrices."""

    clamp: int = 98
    gradient_shares: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9, 0.95, 0.97, 0.99)
    gradients_kept: int = 5
    pearson_threshold: float = 0.9
    euclidean_threshold: float = 1.25
