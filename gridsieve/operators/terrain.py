"""Neighbourhood operators on the pixel table.

Pixels are dealt into square blocks that carry a thin rim of their neighbours.
One shuffle by block then serves every neighbourhood operator: block size, not
raster or area size, bounds what a task holds, so a dominant area spreads evenly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalars import clip
from ..session import attach_small
from .channels import fill_with_median

# Fewest valid pixels for a derivative, sun angles of the relief
# shading, and the spread of the smoothing kernel.
MIN_DERIVATIVE_PIXELS = 10
AZIMUTHS = (315, 45, 225, 135)
ALTITUDE = 45
RELIEF_SIGMA = 10.0
KERNEL_TRUNCATE = 4.0


def deal_into_blocks(
    pixels: DataFrame, block: int, before: int, after: int, partition: bool = True
) -> DataFrame:
    """Copy each pixel to every block whose extent plus rim covers it.

    A block reads ``before`` extra lines ahead of itself and ``after`` behind it.
    """

    def homes(position: str) -> Column:
        first = F.greatest(F.floor((F.col(position) - after) / F.lit(float(block))), F.lit(0))
        last = F.floor((F.col(position) + before) / F.lit(float(block)))
        return F.explode(F.sequence(first.cast("int"), last.cast("int")))

    dealt = pixels.withColumn("blk_r", homes("row")).withColumn("blk_c", homes("col"))
    return dealt.repartition("aoi", "blk_r", "blk_c") if partition else dealt


def neighbours_3x3(pixels: DataFrame, value: str, block: int = 128) -> DataFrame:
    """Add the nine values ``n00..n22`` around each pixel, edges repeated.

    Needs a dense grid.  Both window passes reuse the block partitioning.
    """
    dealt = deal_into_blocks(pixels, block, 1, 1)
    down = W.partitionBy("aoi", "blk_r", "blk_c", "col").orderBy("row")
    along = W.partitionBy("aoi", "blk_r", "blk_c", "row").orderBy("col")
    mid = F.col(value)
    rows = dealt.withColumns(
        {
            "n01": F.coalesce(F.lag(value).over(down), mid),
            "n11": mid,
            "n21": F.coalesce(F.lead(value).over(down), mid),
        }
    )
    sides = {}
    for r in "012":
        centre = f"n{r}1"
        sides[f"n{r}0"] = F.coalesce(F.lag(centre).over(along), F.col(centre))
        sides[f"n{r}2"] = F.coalesce(F.lead(centre).over(along), F.col(centre))
    own = (F.floor(F.col("row") / F.lit(float(block))) == F.col("blk_r")) & (
        F.floor(F.col("col") / F.lit(float(block))) == F.col("blk_c")
    )
    return rows.withColumns(sides).where(own).drop("blk_r", "blk_c")


def _gradients() -> tuple[Column, Column]:
    """Unnormalised Sobel differences along columns and rows."""
    n = {f"{r}{c}": F.col(f"n{r}{c}") for r in range(3) for c in range(3)}
    gx = (n["02"] + 2 * n["12"] + n["22"]) - (n["00"] + 2 * n["10"] + n["20"])
    gy = (n["20"] + 2 * n["21"] + n["22"]) - (n["00"] + 2 * n["01"] + n["02"])
    return gx, gy


def _spread_sums() -> tuple[Column, Column]:
    """Sum and sum of squares of the neighbours' differences from the centre.

    Differences from the centre keep the later subtraction exact for flat ground.
    """
    gaps = [F.col(f"n{r}{c}") - F.col("n11") for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    squares = [g * g for g in gaps]
    return sum(gaps[1:], gaps[0]), sum(squares[1:], squares[0])


_NINE = [f"n{r}{c}" for r in range(3) for c in range(3)]


def terrain_derivatives(
    pixels: DataFrame, block: int = 128, drop_unusable: bool = False
) -> DataFrame:
    """Add ``slope`` (degrees) and ``roughness`` from elevation.

    Holes are filled with the area median for the window and restored after it;
    areas with too few valid pixels get no derivative at all.
    """
    filled = fill_with_median(pixels, "dtm", drop_unusable=drop_unusable)
    around = neighbours_3x3(filled, "filled", block)
    gx, gy = _gradients()
    s1, s2 = _spread_sums()
    keep = F.col("dtm").isNotNull() & (F.col("n_valid") >= MIN_DERIVATIVE_PIXELS)
    g = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy"))
    variance = F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / 9.0) / 9.0, F.lit(0.0))
    # Sums first, in a projection of their own: each is computed once and the
    # generated method stays short enough to be compiled.
    return (
        around.withColumns({"gx": gx, "gy": gy, "s1": s1, "s2": s2})
        .withColumns(
            {
                "slope": F.when(keep, F.degrees(F.atan(g))),
                "roughness": F.when(keep, F.sqrt(variance)),
            }
        )
        .drop(*_NINE, "gx", "gy", "s1", "s2", "filled", "n_valid")
    )


def hillshade(pixels: DataFrame, block: int = 128) -> DataFrame:
    """Mean shading from four directions in 0..255, plus its unscaled value."""
    filled = fill_with_median(pixels, "dtm")
    around = neighbours_3x3(filled, "filled", block)
    gx, gy = (g / 8.0 for g in _gradients())
    alt = float(np.radians(ALTITUDE))
    slope = F.atan(F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy")))
    aspect = F.atan2(-F.col("gy"), F.col("gx"))
    lit = [
        float(np.sin(alt)) * F.sin("slope_rad")
        + float(np.cos(alt)) * F.cos("slope_rad") * F.cos(F.lit(float(np.radians(az))) - F.col("aspect"))
        for az in AZIMUTHS
    ]
    mean = sum(lit[1:], lit[0]) / float(len(AZIMUTHS))
    return (
        around.withColumns({"gx": gx, "gy": gy})
        .withColumns({"slope_rad": slope, "aspect": aspect})
        .withColumn("shade", clip(mean, F.lit(-1.0), F.lit(1.0)))
        .withColumn(
            "shade_byte",
            F.when(F.col("dtm").isNull(), 128)
            .otherwise(F.floor((F.col("shade") + 1) / 2.0 * 255))
            .cast("int"),
        )
        .drop(*_NINE, "gx", "gy", "aspect", "filled", "n_valid")
    )


# ---- wider kernels ---------------------------------------------------------


def gaussian_kernel(sigma: float, truncate: float = KERNEL_TRUNCATE) -> np.ndarray:
    radius = int(truncate * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    return taps / taps.sum()


def box_kernel(size: int) -> np.ndarray:
    if size < 1 or size % 2 == 0:
        raise ValueError("window size must be odd")
    return np.full(size, 1.0 / size)


def _line_weights(first: int, last: int, core: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Weights of the lines ``first..last`` for each core line, edges mirrored.

    Line 0 and, if the block ends before its rim is complete, ``last`` are the
    raster edges; positions outside fold back with the edge line repeated.
    """
    radius = len(kernel) // 2
    reach = core[:, None] + np.arange(-radius, radius + 1)[None, :]
    period = 2 * (last + 1)
    folded = np.mod(reach, period)
    folded = np.where(folded > last, period - 1 - folded, folded)
    weights = np.zeros((len(core), last - first + 1))
    lines = np.repeat(np.arange(len(core)), reach.shape[1])
    np.add.at(weights, (lines, folded.ravel() - first), np.tile(kernel, len(core)))
    return weights


def separable_filter(
    pixels: DataFrame, value: str, kernel: np.ndarray, into: str, block: int = 512
) -> DataFrame:
    """Convolve a dense, hole-free raster with one kernel along both axes.

    Returns ``(aoi, row, col, into)``.  Each task filters whole blocks of at most
    ``block + 2 * radius`` lines with two small matrix products.
    """
    radius = len(kernel) // 2
    block = max(block, radius)
    dealt = deal_into_blocks(
        pixels.select("aoi", "row", "col", value), block, radius, radius, partition=False
    )

    def one_block(table: pa.Table) -> pa.Table:
        aoi, br, bc = (table.column(n)[0].as_py() for n in ("aoi", "blk_r", "blk_c"))
        r, c = table.column("row").to_numpy(), table.column("col").to_numpy()
        r0, r1, c0, c1 = r.min(), r.max(), c.min(), c.max()
        grid = np.zeros((r1 - r0 + 1, c1 - c0 + 1))
        grid[r - r0, c - c0] = table.column(value).to_numpy()
        rows = np.arange(br * block, min((br + 1) * block, r1 + 1))
        cols = np.arange(bc * block, min((bc + 1) * block, c1 + 1))
        if not len(rows) or not len(cols):
            # Only the rim of a block beyond the raster edge.
            rows, cols, out = rows[:0], cols[:0], np.zeros(0)
        else:
            down = _line_weights(r0, r1, rows, kernel)
            out = down @ grid @ _line_weights(c0, c1, cols, kernel).T
        return pa.table(
            {
                "aoi": pa.array([aoi] * out.size, pa.string()),
                "row": pa.array(np.repeat(rows, len(cols)).astype("int32")),
                "col": pa.array(np.tile(cols, len(rows)).astype("int32")),
                into: pa.array(out.ravel()),
            }
        )

    return dealt.groupBy("aoi", "blk_r", "blk_c").applyInArrow(
        one_block, f"aoi string, row int, col int, {into} double"
    )


def local_relief(pixels: DataFrame, sigma: float = RELIEF_SIGMA, block: int = 512) -> DataFrame:
    """Elevation minus its smoothed self, and the display scaling of it."""
    filled = fill_with_median(pixels, "dtm").select("aoi", "row", "col", "dtm", "filled")
    smooth = separable_filter(filled, "filled", gaussian_kernel(sigma), "smooth", block)
    relief = F.col("filled") - F.col("smooth")
    return (
        filled.join(smooth, ["aoi", "row", "col"])
        .withColumn("relief", relief)
        .withColumn("relief_scaled", (clip(F.col("relief"), F.lit(-2.0), F.lit(2.0)) + 2) / 4.0)
        .select("aoi", "row", "col", "dtm", "relief", "relief_scaled")
    )


def roughness_window(pixels: DataFrame, size: int = 3, block: int = 512) -> DataFrame:
    """Roughness for any odd window, from filtered first and second moments."""
    filled = fill_with_median(pixels, "dtm").where(F.col("n_valid") >= MIN_DERIVATIVE_PIXELS)
    base = filled.select("aoi", "row", "col", "dtm", "filled").withColumn(
        "squared", F.col("filled") * F.col("filled")
    )
    taps = box_kernel(size)
    first = separable_filter(base, "filled", taps, "m1", block)
    second = separable_filter(base, "squared", taps, "m2", block)
    keys = ["aoi", "row", "col"]
    variance = F.greatest(F.col("m2") - F.col("m1") * F.col("m1"), F.lit(0.0))
    return (
        base.join(first, keys)
        .join(second, keys)
        .select(*keys, F.when(F.col("dtm").isNotNull(), F.sqrt(variance)).alias("roughness"))
    )


def percentile_stretch(pixels: DataFrame, low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Elevation scaled between two percentiles of its area, clipped to [0, 1]."""
    bounds = exact_quantiles(pixels, ["aoi"], "dtm", {"__lo": low, "__hi": high}).drop("n")
    spread = F.nullif(F.col("__hi") - F.col("__lo"), F.lit(0.0))
    return attach_small(pixels.select("aoi", "row", "col", "dtm"), bounds, ["aoi"]).select(
        "aoi",
        "row",
        "col",
        clip((F.col("dtm") - F.col("__lo")) / spread, F.lit(0.0), F.lit(1.0)).alias("stretched"),
    )
