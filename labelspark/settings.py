"""Thresholds and scale bounds used across the library."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Thresholds:
    """Decision thresholds (fixed values: results depend on them)."""

    brand: float = 95.0
    class_type: float = 90.0
    class_type_review: float = 60.0
    abv_band: float = 0.05
    net_band_ml: float = 0.5
    warning_pass: float = 99.0
    warning_review: float = 85.0
    warning_word: float = 80.0
    read_confidence: float = 55.0
    min_readable_chars: int = 12
    discriminating_chars: int = 5
    min_coverage: float = 0.50
    min_dense_sim: float = 0.80
    judge_floor: float = 3.0


THRESHOLDS = Thresholds()

# Rows per ordering bucket when one logical chain is split over many tasks.
CHAIN_BUCKET_ROWS = 1_000_000
