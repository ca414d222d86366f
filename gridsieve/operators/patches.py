"""Cutting pixels into overlapping patches, and operators on the patch table."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import CHANNELS, PatchGrid
from ..functions.ranking import ordinal_by_line, sample_per_group
from ..functions.scalars import array_mean, patch_id, sanitize_array
from ..schemas import patch_schema
from ..session import attach_small
from .terrain import deal_into_blocks

# Corners of a block per axis; a block of corners plus its rim is one task's unit.
CORNERS_PER_BLOCK = 8


def _first_and_last(position, last_corner_span: int, stride: int):
    """Indices of the patches along one axis that cover a position."""
    low = F.greatest(
        F.floor((position - last_corner_span) / F.lit(float(stride))) + 1, F.lit(0)
    )
    return low.cast("int"), F.floor(position / F.lit(float(stride))).cast("int")


def patch_pixels(pixels: DataFrame, grid: PatchGrid) -> DataFrame:
    """Long form: one row per pixel and covering corner, complete or not.

    ``i, j`` number the patch, ``pr, pc`` place the pixel inside it.  The range
    condition is solved by arithmetic, so there is no join.
    """
    i = F.explode(F.sequence(*_first_and_last(F.col("row"), grid.patch, grid.stride)))
    j = F.explode(F.sequence(*_first_and_last(F.col("col"), grid.patch, grid.stride)))
    return (
        pixels.withColumn("i", i)
        .withColumn("j", j)
        .withColumn("pr", F.col("row") - F.col("i") * grid.stride)
        .withColumn("pc", F.col("col") - F.col("j") * grid.stride)
    )


def patch_moments(pixels: DataFrame, grid: PatchGrid, channels=CHANNELS) -> DataFrame:
    """Count, sum and sum of squares per channel for every complete patch.

    When the patch is a whole number of strides, pixels are first summed into
    stride-sized blocks; only those block sums are copied to the patches that
    share them, a thousandth of the pixels at the default geometry.
    """
    cols = list(channels)
    sums = [F.count(F.lit(1)).alias("px")]
    for c in cols:
        sums += [
            F.count(c).alias(f"{c}_n"),
            F.sum(c).alias(f"{c}_s"),
            F.sum(F.col(c) * F.col(c)).alias(f"{c}_q"),
        ]
    if grid.aligned:
        side = grid.patch // grid.stride
        s = F.lit(float(grid.stride))
        blocks = pixels.groupBy(
            "aoi",
            F.floor(F.col("row") / s).cast("int").alias("bi"),
            F.floor(F.col("col") / s).cast("int").alias("bj"),
        ).agg(*sums)
        span = lambda b: F.explode(F.sequence(F.greatest(F.col(b) - (side - 1), F.lit(0)), F.col(b)))
        parts = blocks.withColumn("i", span("bi")).withColumn("j", span("bj"))
        again = [F.sum("px").alias("px")]
        for c in cols:
            again += [F.sum(f"{c}_{k}").alias(f"{c}_{k}") for k in "nsq"]
        whole = parts.groupBy("aoi", "i", "j").agg(*again)
    else:
        whole = patch_pixels(pixels, grid).groupBy("aoi", "i", "j").agg(*sums)
    return (
        whole.where(F.col("px") == grid.pixels)
        .withColumn("row", (F.col("i") * grid.stride).cast("int"))
        .withColumn("col", (F.col("j") * grid.stride).cast("int"))
        .drop("px", "i", "j")
    )


def valid_patches(
    pixels: DataFrame, grid: PatchGrid, min_valid_ratio: float = 0.7
) -> DataFrame:
    """Complete patches with enough NDVI pixels."""
    counts = patch_moments(pixels, grid, ("ndvi",))
    return counts.where(
        F.col("ndvi_n") / F.lit(float(grid.pixels)) >= min_valid_ratio
    ).select("aoi", "row", "col", F.col("ndvi_n").alias("n_valid"))


def mean_pool_channels(
    pixels: DataFrame, grid: PatchGrid, min_valid_ratio: float = 0.7, channels=CHANNELS
) -> DataFrame:
    """Mean and population deviation of every channel per valid patch."""
    sums = patch_moments(pixels, grid, tuple(dict.fromkeys((*channels, "ndvi"))))
    kept = sums.where(F.col("ndvi_n") / F.lit(float(grid.pixels)) >= min_valid_ratio)
    out = ["aoi", "row", "col", F.col("ndvi_n").alias("n_valid")]
    for c in channels:
        n = F.nullif(F.col(f"{c}_n"), F.lit(0))
        mean = F.col(f"{c}_s") / n
        out += [
            mean.alias(f"{c}_mean"),
            F.sqrt(F.greatest(F.col(f"{c}_q") / n - mean * mean, F.lit(0.0))).alias(f"{c}_std"),
        ]
    return kept.select(*out)


def map_patches(
    pixels: DataFrame,
    grid: PatchGrid,
    fn: Callable[..., dict[str, pa.Array]],
    schema: T.StructType,
    min_valid_ratio: float = 0.7,
    channels=CHANNELS,
    per_patch: bool = True,
    corners_per_block: int = CORNERS_PER_BLOCK,
    placed: bool = False,
) -> DataFrame:
    """Run ``fn`` on the patches of each block without ever storing them.

    Pixels go to blocks of patch corners with a rim of ``patch - stride`` lines.
    That copies about a quarter of them at the default geometry instead of
    sending each pixel to all four patches it belongs to.  ``fn`` receives a
    ``(patches, channels, patch, patch)`` array, NaN where a pixel is missing, and
    returns further columns.  With ``per_patch`` they follow ``aoi, row, col,
    n_valid``; otherwise the columns stand alone, e.g. one row of sums per block.  With
    ``placed`` it also receives the area and the rows and columns of the patches' corners.
    The pixel table must be dense; NDVI decides which patches are kept.
    """
    p, s = grid.patch, grid.stride
    block = s * corners_per_block
    cols = list(channels)
    gate = cols.index("ndvi")
    need = min_valid_ratio * p * p

    def one_block(table: pa.Table) -> pa.Table:
        r = table.column("row").to_numpy()
        c = table.column("col").to_numpy()
        aoi = table.column("aoi")[0].as_py()
        top = table.column("blk_r")[0].as_py() * block
        left = table.column("blk_c")[0].as_py() * block
        # A rim-only block, or one cut short by the raster edge, has fewer corners.
        tall = max(int(r.max()) - top + 1, p)
        broad = max(int(c.max()) - left + 1, p)
        full = int(r.max()) - top + 1 >= p and int(c.max()) - left + 1 >= p
        stack = np.full((len(cols), tall, broad), np.nan)
        for k, name in enumerate(cols):
            stack[k, r - top, c - left] = table.column(name).to_numpy()
        ys = np.arange(0, min(block, tall - p + 1), s)
        xs = np.arange(0, min(block, broad - p + 1), s)
        present = sliding_window_view(np.isfinite(stack[gate]), (p, p))[ys][:, xs]
        counts = present.sum(axis=(2, 3)).ravel()
        kept = np.flatnonzero((counts >= need) & full)
        if not len(kept):
            return schema_arrow.empty_table()
        yy, xx = np.divmod(kept, len(xs))
        x = np.empty((len(kept), len(cols), p, p))
        for n, (y, z) in enumerate(zip(ys[yy], xs[xx])):
            x[n] = stack[:, y : y + p, z : z + p]
        data = fn(x, aoi, top + ys[yy], left + xs[xx]) if placed else fn(x)
        if per_patch:
            data = {
                "aoi": pa.array([aoi] * len(kept), pa.string()),
                "row": pa.array((top + ys[yy]).astype("int32")),
                "col": pa.array((left + xs[xx]).astype("int32")),
                "n_valid": pa.array(counts[kept].astype("int64")),
                **data,
            }
        return pa.table([data[f.name] for f in schema_arrow], names=schema_arrow.names)

    schema_arrow = to_arrow_schema(schema)
    # A block reads no line before its corners and patch - stride lines after them.
    dealt = deal_into_blocks(
        pixels.select("aoi", "row", "col", *[F.col(n).cast("double") for n in cols]),
        block,
        0,
        p - s,
        partition=False,
    )
    return dealt.groupBy("aoi", "blk_r", "blk_c").applyInArrow(one_block, schema)


def extract_patches(
    pixels: DataFrame,
    grid: PatchGrid,
    min_valid_ratio: float = 0.7,
    channels=CHANNELS,
    corners_per_block: int = CORNERS_PER_BLOCK,
) -> DataFrame:
    """Patch table with one row-major array per channel, for models that need it."""
    cols = list(channels)
    size = grid.pixels

    def arrays(x: np.ndarray) -> dict[str, pa.Array]:
        offsets = pa.array(np.arange(len(x) + 1, dtype="int32") * size)
        flat = lambda k: pa.array(np.ascontiguousarray(x[:, k]).ravel(), from_pandas=True)
        return {n: pa.ListArray.from_arrays(offsets, flat(k)) for k, n in enumerate(cols)}

    return map_patches(
        pixels, grid, arrays, patch_schema(cols), min_valid_ratio, cols,
        corners_per_block=corners_per_block,
    )


def number_rows(scored: DataFrame) -> DataFrame:
    """Ordinal and id for narrow rows, which can take part in the ordering."""
    return ordinal_by_line(scored, "aoi", "row", "col").withColumn(
        "patch_id", patch_id(F.col("aoi"), F.col("ordinal"))
    )


def number_patches(patches: DataFrame) -> DataFrame:
    """Add ``ordinal`` in (row, col) order inside each area and the ``patch_id``.

    Positions alone are ordered; the arrays only take part in the last join.
    """
    slim = ordinal_by_line(patches.select("aoi", "row", "col"), "aoi", "row", "col")
    return attach_small(patches, slim, ["aoi", "row", "col"]).withColumn(
        "patch_id", patch_id(F.col("aoi"), F.col("ordinal"))
    )


def sample_patches(patches: DataFrame, n: int, seed: int | str = 42) -> DataFrame:
    """Exactly ``n`` patches per area, all of them where there are fewer."""
    return sample_per_group(patches, ["aoi"], ["row", "col"], n, seed)


def sanitize_patches(patches: DataFrame, channels=CHANNELS) -> DataFrame:
    return patches.withColumns({c: sanitize_array(F.col(c)) for c in channels})


def pool_arrays(patches: DataFrame, channels=CHANNELS) -> DataFrame:
    """Mean of each channel array."""
    return patches.withColumns({f"{c}_mean": array_mean(F.col(c)) for c in channels})


def explode_patches(patches: DataFrame, patch: int, channels=CHANNELS) -> DataFrame:
    """Patch arrays back to rows ``(aoi, row, col, pr, pc, <channels>)``."""
    zipped = F.arrays_zip(*[F.col(c).alias(c) for c in channels])
    keep = [c for c in patches.columns if c not in channels]
    return patches.select(*keep, F.posexplode(zipped).alias("pos", "cell")).select(
        *keep,
        F.floor(F.col("pos") / F.lit(float(patch))).cast("int").alias("pr"),
        (F.col("pos") % patch).cast("int").alias("pc"),
        *[F.col(f"cell.{c}").alias(c) for c in channels],
    )


def broadcast_to_pixels(scores: DataFrame, patch: int, value: str) -> DataFrame:
    """One row per pixel of each patch carrying the patch's score."""
    cells = F.explode(F.sequence(F.lit(0), F.lit(patch * patch - 1)))
    return scores.select("patch_id", value, cells.alias("cell")).select(
        "patch_id",
        F.floor(F.col("cell") / F.lit(float(patch))).cast("int").alias("pr"),
        (F.col("cell") % patch).cast("int").alias("pc"),
        value,
    )
