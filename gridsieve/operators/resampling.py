"""Resampling onto grids that are turned, sheared or scaled against the source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach_small, settle

# Source pixels that one target block may draw on, about; it sets the blocks' size.
PIXELS_PER_BLOCK = 1 << 16
# Positions this close to a whole number, in decimal places, are taken as whole.
WHOLE_PLACES = 9

AFFINE = ("a", "b", "c", "d", "e", "f")


def _block_side(det: Column) -> Column:
    """Side of a target block, so that its share of the source stays near the limit."""
    shrink = F.greatest(F.abs(det), F.lit(1.0))
    side = F.floor(F.sqrt(F.lit(float(PIXELS_PER_BLOCK)) / shrink))
    return F.greatest(side, F.lit(1)).cast("int")


def _sampled(values: np.ndarray, y: np.ndarray, x: np.ndarray, nearest: bool) -> np.ndarray:
    """Dense ``values`` at fractional positions; weights are renormalised over valid cells."""
    height, width = values.shape

    def at(i, j):
        inside = (i >= 0) & (i < height) & (j >= 0) & (j < width)
        return np.where(inside, values[np.clip(i, 0, height - 1), np.clip(j, 0, width - 1)], np.nan)

    if nearest:
        return at(np.floor(y + 0.5).astype(np.int64), np.floor(x + 0.5).astype(np.int64))
    i, j = np.floor(y).astype(np.int64), np.floor(x).astype(np.int64)
    fy, fx = y - i, x - j
    total, weight = np.zeros_like(y), np.zeros_like(y)
    for di, wy in ((0, 1 - fy), (1, fy)):
        for dj, wx in ((0, 1 - fx), (1, fx)):
            v = at(i + di, j + dj)
            share = np.where(np.isnan(v), 0.0, wy * wx)
            total += np.where(np.isnan(v), 0.0, v) * share
            weight += share
    return np.divide(total, weight, out=np.full_like(total, np.nan), where=weight > 0)


def resample_affine(
    source: DataFrame, grids: DataFrame, channels: list[str], method: str = "bilinear"
) -> DataFrame:
    """``channels`` of ``source`` at every pixel of the target grids.

    ``source`` is ``(aoi, row, col, channels)``.  ``grids`` has one row per area: ``height``
    and ``width`` of its target and the affine map from target to source positions,
    ``src_col = a * col + b * row + c`` and ``src_row = d * col + e * row + f``.  Targets
    without any valid source pixel are NULL; null or NaN source values are not valid; areas
    without a grid give no rows, areas without pixels NULL ones.  A map without an inverse
    raises.

    Source pixels travel once, to the target blocks that the inverse map of their
    surroundings touches; the blocks' size follows from the scale, so a task's share of the
    source is bounded whatever the scale and the size of an area.
    """
    if method not in ("bilinear", "nearest"):
        raise ValueError("method must be 'bilinear' or 'nearest'")
    nearest = method == "nearest"
    det = F.col("a") * F.col("e") - F.col("b") * F.col("d")
    flat = F.raise_error(F.lit("the affine map of an area has no inverse")).cast("double")
    placed = grids.select(
        "aoi", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"),
        *[F.col(k).cast("double").alias(k) for k in AFFINE],
    ).withColumn("det", F.when(det != 0, det).otherwise(flat))
    # One row per area; written, so that it is no part of a plan it may be derived from.
    placed = settle(placed.withColumn("side", _block_side(F.col("det"))), "grids")

    side = F.col("side")
    last = {"br": F.ceil(F.col("height") / side) - 1, "bc": F.ceil(F.col("width") / side) - 1}
    blocks = (
        placed.where("height > 0 and width > 0")
        .withColumn("br", F.explode(F.sequence(F.lit(0), last["br"].cast("int"))))
        .withColumn("bc", F.explode(F.sequence(F.lit(0), last["bc"].cast("int"))))
    )

    valid = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in channels]
    some = valid[0]
    for v in valid[1:]:
        some = some | v
    pixels = source.where(some).select(
        "aoi", F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"),
        *[F.col(c).cast("double").alias(c) for c in channels],
    )
    # The target positions that use a source pixel lie within one source step of it.
    dx, dy = F.col("col") - F.col("c"), F.col("row") - F.col("f")
    centre = {
        "br": (F.col("a") * dy - F.col("d") * dx) / F.col("det"),
        "bc": (F.col("e") * dx - F.col("b") * dy) / F.col("det"),
    }
    reach = {
        "br": (F.abs("a") + F.abs("d")) / F.abs("det"),
        "bc": (F.abs("e") + F.abs("b")) / F.abs("det"),
    }

    def touched(k: str) -> Column:
        slack = reach[k] + 1e-6
        low = F.greatest(F.floor((centre[k] - slack) / side), F.lit(0)).cast("int")
        high = F.least(F.floor((centre[k] + slack) / side), last[k]).cast("int")
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    known = attach_small(pixels, placed, ["aoi"], "inner")
    dealt = (
        known.withColumn("rs", touched("br"))
        .withColumn("cs", touched("bc"))
        .select("aoi", "row", "col", *channels, F.explode("rs").alias("br"), "cs")
        .select("aoi", "row", "col", *channels, "br", F.explode("cs").alias("bc"))
    )

    fields = pa.schema(
        [("aoi", pa.string()), ("row", pa.int32()), ("col", pa.int32())]
        + [(c, pa.float64()) for c in channels]
    )

    def sample(grid: pa.Table, found: pa.Table) -> pa.Table:
        if grid.num_rows == 0:
            return fields.empty_table()
        g = grid.slice(0, 1).to_pylist()[0]
        rows = np.arange(g["br"] * g["side"], min((g["br"] + 1) * g["side"], g["height"]))
        cols = np.arange(g["bc"] * g["side"], min((g["bc"] + 1) * g["side"], g["width"]))
        r, c = (m.ravel() for m in np.meshgrid(rows, cols, indexing="ij"))
        x = np.round(g["a"] * c + g["b"] * r + g["c"], WHOLE_PLACES)
        y = np.round(g["d"] * c + g["e"] * r + g["f"], WHOLE_PLACES)
        out = [pa.array([g["aoi"]] * len(r), pa.string()), pa.array(r, pa.int32()), pa.array(c, pa.int32())]
        if found.num_rows == 0:
            return pa.Table.from_arrays(
                out + [pa.nulls(len(r), pa.float64())] * len(channels), schema=fields
            )
        sr, sc = found["row"].to_numpy(), found["col"].to_numpy()
        top, left = int(sr.min()), int(sc.min())
        shape = (int(sr.max()) - top + 1, int(sc.max()) - left + 1)
        for name in channels:
            dense = np.full(shape, np.nan)
            dense[sr - top, sc - left] = found[name].to_numpy()
            got = _sampled(dense, y - top, x - left, nearest)
            out.append(pa.array(got, pa.float64(), mask=np.isnan(got)))
        return pa.Table.from_arrays(out, schema=fields)

    schema = "aoi string, row int, col int, " + ", ".join(f"`{c}` double" for c in channels)
    keys = ("aoi", "br", "bc")
    return blocks.groupBy(*keys).cogroup(dealt.groupBy(*keys)).applyInArrow(sample, schema)
