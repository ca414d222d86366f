"""Linear autoencoder over whole patches: randomised power iterations with partial sums."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...config import CHANNELS
from ..similarity import matrix_as_rows
from .embedding import _as_stack
from .partials import merged

COMPONENTS = 8
OVERSAMPLE = 8
POWER = 3
SEED = 42


@dataclass
class LinearAutoencoder:
    """Mean patch and orthonormal components of flattened patches, with their energy.

    ``energy`` is the sum of squared projections on each component, ``total`` the sum of
    squared distances from the mean, over ``n`` patches.
    """

    mean: np.ndarray
    basis: np.ndarray
    energy: np.ndarray
    total: float
    n: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.basis

    def rebuild(self, x: np.ndarray) -> np.ndarray:
        return self.codes(x) @ self.basis.T + self.mean


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    x = _as_stack(batch.columns)
    return x.reshape(len(x), -1)


def fit_autoencoder(
    patches: DataFrame,
    channels=CHANNELS,
    components: int = COMPONENTS,
    power: int = POWER,
    seed: int = SEED,
) -> LinearAutoencoder | None:
    """Fit on the sanitised channel arrays of a patch table, whatever their length.

    A random subspace is multiplied by the scatter of the patches ``power + 1`` times; each
    pass over the patches adds up (cells x subspace) products inside the tasks first, so the
    scatter matrix itself, cells by cells, is never formed.  The best directions inside the
    final subspace are the components.  The driver holds a few such products, whose size is
    fixed by the patch and not by the data.  None without patches.
    """
    rows = patches.select(*channels)

    def count_and_sum(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            x = _flat(batch)
            part = np.concatenate(([len(x)], x.sum(axis=0)))
            out = part if out is None else out + part
        return out

    first = merged(rows, count_and_sum)
    if first is None:
        return None
    n, mean = int(first[0]), first[1:] / first[0]
    width = min(components + OVERSAMPLE, len(mean))
    start = np.random.default_rng(seed).normal(size=(len(mean), width))
    v = np.linalg.qr(start)[0]

    def products(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            x = _flat(batch) - mean
            part = (x.T @ (x @ v)).ravel()
            out = part if out is None else out + part
        return out

    for _ in range(power + 1):
        v = np.linalg.qr(merged(rows, products).reshape(v.shape))[0]

    def energies(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            x = _flat(batch) - mean
            y = x @ v
            part = np.concatenate(([np.square(x).sum()], (y.T @ y).ravel()))
            out = part if out is None else out + part
        return out

    last = merged(rows, energies)
    values, turn = np.linalg.eigh(last[1:].reshape(width, width))
    best = np.argsort(-values)[:components]
    return LinearAutoencoder(mean, v @ turn[:, best], values[best], float(last[0]), n)


def autoencoder_scores(
    patches: DataFrame, model: LinearAutoencoder, channels=CHANNELS, with_pixels: bool = False
) -> DataFrame:
    """Squared error and uncertainty of the rebuilt patch, averaged over all its channels.

    ``mse`` and ``uncertainty`` (1 at a value of 0.5, falling to 0 at 0 and 1) are means over
    the whole patch; ``with_pixels`` adds ``pixel_mse`` and ``pixel_uncertainty``, the means
    over the channels of every pixel, row by row.  The channel arrays are dropped.
    """
    held = patches.sparkSession.sparkContext.broadcast(model)
    names = ["mse", "uncertainty", *(("pixel_mse", "pixel_uncertainty") if with_pixels else ())]
    kinds = ["double", "double", "array<double>", "array<double>"]
    schema = ", ".join(f"{n}: {k}" for n, k in zip(names, kinds))

    @F.arrow_udf(f"struct<{schema}>")
    def rebuilt(*arrays: pa.Array) -> pa.Array:
        x = _as_stack(arrays)
        flat = x.reshape(len(x), -1)
        out = held.value.rebuild(flat).reshape(x.shape)
        pixels = [((x - out) ** 2).mean(axis=1), (1.0 - np.abs(out - 0.5) * 2.0).mean(axis=1)]
        made = [pa.array(p.mean(axis=1)) for p in pixels]
        if with_pixels:
            made += [matrix_as_rows(p) for p in pixels]
        return pa.StructArray.from_arrays(made, names)

    keep = [c for c in patches.columns if c not in channels]
    scored = patches.select(*keep, rebuilt(*[F.col(c) for c in channels]).alias("__r"))
    return scored.select(*keep, *[F.col(f"__r.{n}").alias(n) for n in names])


def autoencoder_codes(
    patches: DataFrame, model: LinearAutoencoder, channels=CHANNELS, into: str = "embedding"
) -> DataFrame:
    """The components' weights of every patch, as an embedding."""
    held = patches.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def codes(*arrays: pa.Array) -> pa.Array:
        x = _as_stack(arrays)
        return matrix_as_rows(held.value.codes(x.reshape(len(x), -1)))

    return patches.withColumn(into, codes(*[F.col(c) for c in channels]))

