"""Cross-correlation with templates of any size, by Fourier transforms inside blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .terrain import deal_into_blocks

# Up to so many cells the direct sum is cheaper than the transforms.
DIRECT_CELLS = 32


def _good_size(n: int) -> int:
    """The next length whose only prime factors are 2, 3 and 5."""
    while True:
        rest = n
        for p in (2, 3, 5):
            while rest % p == 0:
                rest //= p
        if rest == 1:
            return n
        n += 1


def valid_correlations(x: np.ndarray, templates: list[np.ndarray]):
    """Correlation of a stack ``(n, height, width)`` with each template, whole overlaps only.

    Large templates share one transform of the stack; its length is that of the stack, as
    offsets with a whole overlap never wrap round.
    """
    height, width = x.shape[1:]
    shape = (_good_size(height), _good_size(width))
    spectrum = None
    for t in templates:
        h, w = t.shape
        if h > height or w > width:
            raise ValueError("template larger than the data")
        if t.size <= DIRECT_CELLS:
            out = np.zeros((len(x), height - h + 1, width - w + 1))
            for dy in range(h):
                for dx in range(w):
                    out += t[dy, dx] * x[:, dy : dy + height - h + 1, dx : dx + width - w + 1]
        else:
            if spectrum is None:
                spectrum = np.fft.rfft2(x, shape)
            product = spectrum * np.conj(np.fft.rfft2(t, shape))
            out = np.fft.irfft2(product, shape)[:, : height - h + 1, : width - w + 1]
        yield out


def _window_sums(x: np.ndarray, h: int, w: int) -> np.ndarray:
    """Sums over every whole ``h x w`` window."""
    for axis, n in ((0, h), (1, w)):
        pad = [(1, 0) if k == axis else (0, 0) for k in range(2)]
        total = np.pad(np.cumsum(x, axis=axis), pad)
        ahead = np.take(total, range(n, total.shape[axis]), axis=axis)
        x = ahead - np.take(total, range(total.shape[axis] - n), axis=axis)
    return x


def template_field(
    pixels: DataFrame, template: np.ndarray, value: str, into: str = "similarity", block: int = 256
) -> DataFrame:
    """Correlation of ``template`` with the window that starts at each pixel, by lengths.

    Rows ``(aoi, row, col, into)`` for pixels whose whole window lies among the pixels of the
    area; missing values count as zero.  Blocks overlap by the template's rim (overlap-save),
    pixels are shuffled once, and a block is at least three rims wide, so that few pixels
    travel twice.
    """
    t = np.asarray(template, dtype=float)
    h, w = t.shape
    rim = max(h, w) - 1
    block = max(block, 3 * rim, 1)
    side = block + rim
    norm = float(np.sqrt((t * t).sum()))
    fields = pa.schema(
        [("aoi", pa.string()), ("row", pa.int32()), ("col", pa.int32()), (into, pa.float64())]
    )

    def one_block(rows: pa.Table) -> pa.Table:
        area, br, bc = (rows.column(n)[0].as_py() for n in ("aoi", "blk_r", "blk_c"))
        i = rows["row"].to_numpy().astype(np.int64) - br * block
        j = rows["col"].to_numpy().astype(np.int64) - bc * block
        x, there = np.zeros((side, side)), np.zeros((side, side))
        x[i, j] = np.nan_to_num(
            rows["v"].to_numpy(zero_copy_only=False), nan=0.0, posinf=0.0, neginf=0.0
        )
        there[i, j] = 1.0
        corr = next(valid_correlations(x[None], [t]))[0]
        length = np.sqrt(np.maximum(_window_sums(x * x, h, w), 0.0))
        whole = _window_sums(there, h, w) > h * w - 0.5
        r, c = np.nonzero(whole[:block, :block])
        score = corr[r, c] / (length[r, c] * norm + 1e-10)
        return pa.Table.from_arrays(
            [
                pa.array([area] * len(r), pa.string()),
                pa.array(r + br * block, pa.int32()),
                pa.array(c + bc * block, pa.int32()),
                pa.array(score, pa.float64()),
            ],
            schema=fields,
        )

    kept = pixels.select("aoi", "row", "col", F.col(value).cast("double").alias("v"))
    dealt = deal_into_blocks(kept, block, 0, rim, partition=False)
    return dealt.groupBy("aoi", "blk_r", "blk_c").applyInArrow(
        one_block, f"aoi string, row int, col int, {into} double"
    )
