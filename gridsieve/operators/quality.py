"""Data-quality rules as violation tables and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS, UNIFIED_COLUMNS


def malformed_patches(patches: DataFrame, patch: int, channels=CHANNELS) -> DataFrame:
    """Patches whose channel arrays are missing or not ``patch * patch`` long."""
    bad = None
    for c in channels:
        wrong = F.coalesce(F.size(c) != patch * patch, F.lit(True))
        bad = wrong if bad is None else bad | wrong
    return patches.where(bad)


def _count(rule: str, rows: DataFrame, broken: Column) -> DataFrame:
    return rows.agg(
        F.lit(rule).alias("rule"),
        F.count(F.lit(1)).alias("checked"),
        F.count_if(F.coalesce(broken, F.lit(True))).alias("violations"),
    )


def rule_violations(
    scores: DataFrame, stats: DataFrame, summary: DataFrame, score_columns=UNIFIED_COLUMNS
) -> DataFrame:
    """Checked and broken row counts of every rule; NULL breaks a rule."""
    outside = None
    for c in score_columns:
        here = ~F.col(c).between(0.0, 1.0)
        outside = here if outside is None else outside | here
    identity = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("patch_id") == "")
    return (
        _count("std_positive", stats, F.col("std") <= 0)
        .unionByName(_count("scores_in_unit_range", scores, outside))
        .unionByName(
            _count(
                "anomalies_within_total",
                summary,
                F.col("anomalies_detected") > F.col("total_patches"),
            )
        )
        .unionByName(_count("identity_and_position", scores, identity))
    )
