"""Scores from the fractions of mask values under a region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_score(fractions: Column, value: str, mode: str = "reference") -> Column:
    """1 less the fraction of pixels of the undesired `value`; no fractions at all score 0.

    `reference`: a fraction that is missing, null or 0 counts as 1, so a region without any such pixel scores 0 and 1 is never reached.
    `documented`: such a fraction counts as 0, so that region scores 1. NaN stays NaN in both.
    """
    return F.when(fractions.isNull(), F.lit(0.0)).otherwise(share_score(F.try_element_at(fractions, F.lit(value)), mode))


def share_score(fraction: Column, mode: str = "reference") -> Column:
    """1 less a fraction, which may be null; see `overlap_score`."""
    if mode == "reference":
        return F.lit(1.0) - F.coalesce(F.nullif(fraction, F.lit(0.0)), F.lit(1.0))
    if mode == "documented":
        return F.lit(1.0) - F.coalesce(fraction, F.lit(0.0))
    raise ValueError(f"unknown mode {mode!r}")


def positive(score: Column) -> Column:
    """score > 0, false for NaN (which Spark orders above all numbers)."""
    return ~F.isnan(score) & (score > 0.0)
