"""Deterministic train/test splits with exact sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import rank_cut


def _side(marked: DataFrame) -> DataFrame:
    return marked.withColumn("side", F.when(F.col("in_train"), "train").otherwise("test")).drop(
        "in_train"
    )


def split_areas(rows: DataFrame, train_ratio: float = 0.8, seed: int | str = 42) -> DataFrame:
    """Whole areas to one side, so overlapping patches never leak."""
    return _side(rank_cut(rows.select("aoi").distinct(), ["aoi"], train_ratio, seed))


def split_patches(rows: DataFrame, train_ratio: float = 0.8, seed: int | str = 42) -> DataFrame:
    """Patch-level split; overlapping neighbours may end up on both sides."""
    return _side(rank_cut(rows, ["patch_id"], train_ratio, seed))


def split_stratified(
    rows: DataFrame, label: str, train_ratio: float = 0.8, seed: int | str = 42
) -> DataFrame:
    """The ratio holds inside every label."""
    return _side(rank_cut(rows, ["patch_id"], train_ratio, seed, strata=label))
