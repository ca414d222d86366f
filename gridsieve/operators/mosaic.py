"""Putting overlapping patches back on the area grid."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import CHANNELS, PatchGrid
from .patches import map_patches

# Lower and upper bound of the blending weight.
MIN_WEIGHT = 0.1
MAX_WEIGHT = 1.0


def area_extent(patches: DataFrame, patch: int) -> DataFrame:
    """Height and width of each area as far as its patches reach."""
    return patches.groupBy("aoi").agg(
        (F.max("row") + patch).cast("int").alias("height"),
        (F.max("col") + patch).cast("int").alias("width"),
    )


def dense_cells(extent: DataFrame, step: int = 1) -> DataFrame:
    """Every ``step``-sized cell ``(aoi, r, c)`` of the extents.

    Lines are spread over the cluster before they are filled, so that one very
    large area does not unfold in a single task.
    """
    count = lambda n: (F.ceil(F.col(n) / F.lit(float(step))) - 1).cast("int")
    lines = extent.withColumn("r", F.explode(F.sequence(F.lit(0), count("height"))))
    return (
        lines.repartition("aoi", "r")
        .withColumn("c", F.explode(F.sequence(F.lit(0), count("width"))))
        .select("aoi", "r", "c")
    )


def heatmap_blocks(scores: DataFrame, grid: PatchGrid, value: str) -> DataFrame:
    """Overlap mean of patch-constant scores per stride-sized block, uncovered blocks 0.

    All pixels of a block are covered by the same patches, so one value stands
    for ``stride * stride`` pixels.  A patch that is not placed on the stride raises.
    """
    if not grid.aligned:
        raise ValueError("block heatmap needs patch % stride == 0")
    side, s = grid.patch // grid.stride, F.lit(float(grid.stride))
    placed = lambda c: F.when(F.col(c) % grid.stride == 0, F.floor(F.col(c) / s)).otherwise(
        F.raise_error(F.lit("block heatmap needs patches on the stride"))
    )
    span = lambda c: F.explode(
        F.sequence(placed(c).cast("int"), (placed(c) + side - 1).cast("int"))
    )
    covered = (
        scores.select("aoi", value, "row", span("col").alias("c"))
        .withColumn("r", span("row"))
        .groupBy("aoi", "r", "c")
        .agg(F.avg(value).alias(value))
    )
    cells = dense_cells(area_extent(scores, grid.patch), grid.stride)
    return cells.join(covered, ["aoi", "r", "c"], "left").withColumn(
        value, F.coalesce(value, F.lit(0.0))
    )


def expand_blocks(blocks: DataFrame, stride: int, value: str) -> DataFrame:
    """Block values to pixels, for a sink that wants the full raster.

    The blocks are few bytes for what they unfold to, so they are dealt over all cores first;
    by their size alone, adaptive execution would leave them to a few tasks.
    """
    spark = blocks.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(parts, 4 * spark.sparkContext.defaultParallelism)
    inner = F.sequence(F.lit(0), F.lit(stride - 1))
    return (
        blocks.repartition(parts, "aoi", "r", "c")
        .withColumn("dr", F.explode(inner))
        .withColumn("dc", F.explode(inner))
        .select(
            "aoi",
            (F.col("r") * stride + F.col("dr")).cast("int").alias("row"),
            (F.col("c") * stride + F.col("dc")).cast("int").alias("col"),
            value,
        )
    )


def heatmap_mean(
    scores: DataFrame, grid: PatchGrid, value: str, places: int | None = None
) -> DataFrame:
    """Overlap mean of patch scores for every pixel of the extent, rounded to ``places``."""
    final = lambda c: c if places is None else F.round(c, places)
    off_grid = (F.col("row") % grid.stride != 0) | (F.col("col") % grid.stride != 0)
    if grid.aligned and scores.where(off_grid).isEmpty():
        # A block is rounded once for all of its pixels.
        blocks = heatmap_blocks(scores, grid, value).withColumn(value, final(F.col(value)))
        return expand_blocks(blocks, grid.stride, value)
    inner = F.sequence(F.lit(0), F.lit(grid.patch - 1))
    covered = (
        scores.select("aoi", "row", "col", value, F.explode(inner).alias("dr"))
        .withColumn("dc", F.explode(inner))
        .groupBy(
            "aoi", (F.col("row") + F.col("dr")).alias("r"), (F.col("col") + F.col("dc")).alias("c")
        )
        .agg(F.avg(value).alias(value))
    )
    cells = dense_cells(area_extent(scores, grid.patch))
    return cells.join(covered, ["aoi", "r", "c"], "left").select(
        "aoi",
        F.col("r").alias("row"),
        F.col("c").alias("col"),
        final(F.coalesce(value, F.lit(0.0))).alias(value),
    )


def pixel_heatmap(pixel_scores: DataFrame, value: str) -> DataFrame:
    """Overlap mean of per-pixel patch scores ``(aoi, row, col, pr, pc, value)``."""
    return pixel_scores.groupBy(
        "aoi",
        (F.col("row") + F.col("pr")).alias("row"),
        (F.col("col") + F.col("pc")).alias("col"),
    ).agg(F.avg(value).alias(value))


def blend_weight(pr: Column, pc: Column, patch: int) -> Column:
    """Weight falling with the squared distance from the patch centre."""
    centre = patch // 2
    reach = math.sqrt(2.0) * centre
    away = F.sqrt((pr - centre) * (pr - centre) + (pc - centre) * (pc - centre)) / reach
    return F.greatest(F.least(1.0 - away * away, F.lit(MAX_WEIGHT)), F.lit(MIN_WEIGHT))


def blended_errors(
    pixels: DataFrame, grid: PatchGrid, template: DataFrame, min_valid_ratio: float = 0.7,
    channels=CHANNELS, weighted: bool = True,
) -> DataFrame:
    """Rows ``(aoi, row, col, weight, squared_error)``: the patches' pixel errors, averaged
    over all channels and blended where patches overlap.

    The patches of a block are blended inside it, so only the lines that blocks share are
    added up in the shuffle, and no patch is taken apart into rows.
    """
    from .models.embedding import _shared_template, cell_errors

    ref, p = _shared_template(template, channels), grid.patch
    away = (np.arange(p) - p // 2) ** 2
    shape = 1.0 - (away[:, None] + away[None, :]) / (2.0 * (p // 2) ** 2)
    weights = np.clip(shape, MIN_WEIGHT, MAX_WEIGHT) if weighted else np.ones((p, p))

    def blend(x: np.ndarray, aoi: str, rows: np.ndarray, cols: np.ndarray) -> dict[str, pa.Array]:
        errors = cell_errors(x, ref.value)["squared_error"] * weights
        top, left = int(rows.min()), int(cols.min())
        size = int(rows.max()) - top + p, int(cols.max()) - left + p
        total, weight = np.zeros(size), np.zeros(size)
        for e, r, c in zip(errors, rows - top, cols - left):
            total[r : r + p, c : c + p] += e
            weight[r : r + p, c : c + p] += weights
        r, c = np.nonzero(weight)
        return {
            "aoi": pa.array([aoi] * len(r), pa.string()),
            "row": pa.array((r + top).astype("int32")), "col": pa.array((c + left).astype("int32")),
            "weight": pa.array(weight[r, c]), "total": pa.array(total[r, c]),
        }

    schema = T.StructType.fromDDL("aoi string, row int, col int, weight double, total double")
    parts = map_patches(
        pixels, grid, blend, schema, min_valid_ratio, channels, per_patch=False, placed=True
    )
    whole = parts.groupBy("aoi", "row", "col").agg(
        F.sum("weight").alias("weight"), F.sum("total").alias("total")
    )
    return whole.select(
        "aoi", "row", "col", "weight", (F.col("total") / F.col("weight")).alias("squared_error")
    )


def mosaic_weighted(
    patch_cells: DataFrame, patch: int, values: list[str], weighted: bool = True
) -> DataFrame:
    """Blend patch pixels ``(aoi, row, col, pr, pc, <values>)`` into one raster.

    Returns covered pixels only, with ``weight``; an absent pixel is uncovered.
    """
    w = blend_weight(F.col("pr"), F.col("pc"), patch) if weighted else F.lit(1.0)
    sums = [F.sum("__w").alias("weight")]
    sums += [F.sum(F.col(v) * F.col("__w")).alias(v) for v in values]
    blended = (
        patch_cells.withColumn("__w", w)
        .groupBy(
            "aoi",
            (F.col("row") + F.col("pr")).alias("row"),
            (F.col("col") + F.col("pc")).alias("col"),
        )
        .agg(*sums)
    )
    return blended.withColumns({v: F.col(v) / F.col("weight") for v in values})


def mosaic_coverage(mosaic: DataFrame, extent: DataFrame) -> DataFrame:
    """Share of covered pixels in percent and mean weight where covered."""
    covered = mosaic.groupBy("aoi").agg(
        F.count(F.lit(1)).alias("covered"), F.avg("weight").alias("mean_overlap")
    )
    area = F.col("height").cast("long") * F.col("width")
    return extent.join(covered, "aoi", "left").select(
        "aoi",
        F.coalesce("covered", F.lit(0)).alias("covered"),
        (F.coalesce("covered", F.lit(0)) / area * 100.0).alias("coverage_pct"),
        F.coalesce("mean_overlap", F.lit(0.0)).alias("mean_overlap"),
    )


def positive_area(blocks: DataFrame, value: str, threshold: float = 0.5) -> DataFrame:
    """Share of the heatmap at or above the threshold, in percent.

    Works on blocks as on pixels: all cells of one area have the same size.
    """
    return blocks.groupBy("aoi").agg(
        (F.avg((F.col(value) >= threshold).cast("double")) * 100).alias("positive_pct")
    )
