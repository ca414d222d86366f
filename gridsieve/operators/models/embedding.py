"""Patch features, reconstructions, and a hook for user-supplied models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...config import CHANNELS, PatchGrid
from ..correlation import valid_correlations
from ...functions.scalars import array_mean
from ...schemas import patch_schema
from ..similarity import matrix_as_rows, rows_as_matrix


def _as_stack(arrays) -> np.ndarray:
    """Channel list columns as one (rows, channels, pixels) array, NULL to 0."""
    return np.nan_to_num(np.stack([rows_as_matrix(a) for a in arrays], axis=1), posinf=0.0, neginf=0.0)


# ---- moments and PCA embedding ---------------------------------------------


def patch_moment_vector(patches: DataFrame, channels=CHANNELS, into: str = "embedding") -> DataFrame:
    """Mean, deviation, minimum and maximum of every sanitised channel as one vector."""

    @F.arrow_udf("array<double>")
    def moments(*arrays: pa.Array) -> pa.Array:
        x = _as_stack(arrays)
        out = np.stack([x.mean(2), x.std(2), x.min(2), x.max(2)], axis=2).reshape(len(x), -1)
        return matrix_as_rows(out)

    return patches.withColumn(into, moments(*[F.col(c) for c in channels]))


def fit_pca(rows: DataFrame, vector: str, k: int):
    data = rows.select(array_to_vector(vector).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="pc").fit(data)


def pca_embedding(rows: DataFrame, model, vector: str, into: str = "embedding") -> DataFrame:
    return (
        model.transform(rows.withColumn("v", array_to_vector(vector)))
        .withColumn(into, vector_to_array("pc"))
        .drop("v", "pc")
    )


def user_model(
    make_predict_fn: Callable, channels=CHANNELS, shape=None, batch_size: int = 32,
    returns: T.DataType | None = None,
) -> Callable:
    """Wrap a user's batch model; it is loaded once per Python worker.

    The callable returned takes the channel columns of a sanitised patch table.
    """
    return predict_batch_udf(
        make_predict_fn,
        return_type=returns or T.ArrayType(T.FloatType()),
        batch_size=batch_size,
        input_tensor_shapes=[list(shape)] * len(channels) if shape else None,
    )


# ---- reconstruction by the mean patch --------------------------------------


def mean_patch(patches: DataFrame, channels=CHANNELS) -> DataFrame:
    """Mean of every pixel position over a patch table: ``(pos, <channels>)``."""
    names = list(channels)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([rows_as_matrix(batch.column(i)) for i in range(len(names))], axis=1)
                yield pa.RecordBatch.from_pydict(_position_sums(x))

    return _finish_means(patches.select(*names).mapInArrow(sums, _SUMS), names)


def mean_patch_of_pixels(
    pixels: DataFrame, grid: PatchGrid, min_valid_ratio: float = 0.7, channels=CHANNELS
) -> DataFrame:
    """The same mean straight from pixels; no patch is stored."""
    from ..patches import map_patches

    flat = lambda x: _position_sums(x.reshape(len(x), x.shape[1], -1))
    partial = map_patches(
        pixels, grid, flat, _SUMS, min_valid_ratio, channels, per_patch=False
    )
    return _finish_means(partial, list(channels))


_SUMS = T.StructType(
    [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("total", "present")]
)


def _position_sums(x: np.ndarray) -> dict[str, pa.Array]:
    """Sum and count per channel and position over the first axis, as one row."""
    total, present = np.zeros(x.shape[1:]), np.zeros(x.shape[1:])
    for patch in x:
        valid = np.isfinite(patch)
        np.add(total, patch, out=total, where=valid)
        present += valid
    parts = {"total": total, "present": present}
    return {n: matrix_as_rows(a.reshape(1, -1)) for n, a in parts.items()}


def _finish_means(partial: DataFrame, names: list[str]) -> DataFrame:
    """Add up block sums cell by cell, first inside each task.

    Spark adds them up: the blocks come from Python, and a second function behind them would
    keep a second Python worker for every task.
    """
    cells = (
        partial.select(F.posexplode(F.arrays_zip("total", "present")).alias("at", "c"), F.size("total").alias("n"))
        .select(
            (F.col("at") % (F.col("n") / len(names)).cast("int")).alias("pos"),
            F.floor(F.col("at") / (F.col("n") / len(names))).cast("int").alias("channel"),
            "c.total",
            "c.present",
        )
    )
    pick = lambda i, what: F.sum(F.when(F.col("channel") == i, F.col(what)))
    means = [
        (pick(i, "total") / F.nullif(pick(i, "present"), F.lit(0.0))).alias(c)
        for i, c in enumerate(names)
    ]
    return cells.groupBy("pos").agg(*means)


def mean_patch_error(
    patches: DataFrame, template: DataFrame, channels=CHANNELS, into: str = "mse"
) -> DataFrame:
    """Mean squared distance of a patch from the mean patch over its valid pixels."""
    ref = _shared_template(template, channels)

    @F.arrow_udf("double")
    def error(*arrays: pa.Array) -> pa.Array:
        return _mean_square_gap(np.stack([rows_as_matrix(a) for a in arrays], axis=1), ref.value)

    return patches.withColumn(into, error(*[F.col(c) for c in channels]))


def mean_patch_error_of_pixels(
    pixels: DataFrame, grid: PatchGrid, template: DataFrame, min_valid_ratio: float = 0.7,
    channels=CHANNELS,
) -> DataFrame:
    """Rows ``(aoi, row, col, n_valid, mse)`` straight from pixels."""
    from ..patches import map_patches

    ref = _shared_template(template, channels)
    flat = lambda x: {"mse": _mean_square_gap(x.reshape(len(x), x.shape[1], -1), ref.value)}
    schema = T.StructType(patch_schema(()).fields + [T.StructField("mse", T.DoubleType())])
    return map_patches(pixels, grid, flat, schema, min_valid_ratio, channels)


def cell_errors(x: np.ndarray, ref: np.ndarray) -> dict[str, np.ndarray]:
    """Error of every pixel of sanitised (n, channels, patch, patch) pixels against a mean
    patch, averaged over all channels: (n, patch, patch) each."""
    gap = np.nan_to_num(x, posinf=0.0, neginf=0.0) - np.nan_to_num(ref).reshape(x.shape[1:])
    return {"abs_error": np.abs(gap).mean(axis=1), "squared_error": np.square(gap).mean(axis=1)}


def patch_errors_of_pixels(
    pixels: DataFrame, grid: PatchGrid, template: DataFrame, min_valid_ratio: float = 0.7,
    channels=CHANNELS,
) -> DataFrame:
    """Rows ``(aoi, row, col, n_valid, mse, abs_error, squared_error)`` straight from pixels.

    The two errors are arrays with the channel mean of every pixel, row by row; ``mse`` is
    the mean over the whole patch.
    """
    from ..patches import map_patches

    ref = _shared_template(template, channels)

    def errors(x: np.ndarray) -> dict[str, pa.Array]:
        found = cell_errors(x, ref.value)
        out = {n: matrix_as_rows(e.reshape(len(x), -1)) for n, e in found.items()}
        return {"mse": pa.array(found["squared_error"].mean(axis=(1, 2))), **out}

    arrays = [T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("abs_error", "squared_error")]
    schema = T.StructType(patch_schema(()).fields + [T.StructField("mse", T.DoubleType()), *arrays])
    return map_patches(pixels, grid, errors, schema, min_valid_ratio, channels)


def _shared_template(template: DataFrame, channels):
    """The mean patch for all tasks; one row per pixel of a patch, fixed by the geometry."""
    table = template.orderBy("pos").toArrow()
    return template.sparkSession.sparkContext.broadcast(
        np.stack([table.column(c).to_numpy().astype(float) for c in channels])
    )


def _mean_square_gap(x: np.ndarray, ref: np.ndarray) -> pa.Array:
    out = np.full(len(x), np.nan)
    # One patch at a time stays in the processor cache.
    for n, patch in enumerate(x):
        gap = (patch - ref).ravel()
        gap = gap[np.isfinite(gap)]
        if len(gap):
            out[n] = np.square(gap).sum() / len(gap)
    return pa.array(out, from_pandas=True)


# ---- linear autoencoder ----------------------------------------------------


def pooled_vector(
    patches: DataFrame, grid: PatchGrid, pool: int, channels=CHANNELS, into: str = "pooled"
) -> DataFrame:
    """Sanitised channels averaged over ``pool x pool`` cells, as one vector."""
    side = grid.patch // pool
    if side * pool != grid.patch:
        raise ValueError("pool must divide the patch size")
    if side * side * len(channels) > 4096:
        raise ValueError("pooled vector too long for a covariance fit")

    @F.arrow_udf("array<double>")
    def shrink(*arrays: pa.Array) -> pa.Array:
        x = _as_stack(arrays)
        cells = x.reshape(len(x), len(arrays), side, pool, side, pool).mean(axis=(3, 5))
        return matrix_as_rows(cells.reshape(len(x), -1))

    return patches.withColumn(into, shrink(*[F.col(c) for c in channels]))


def pca_reconstruction(
    rows: DataFrame, vector: str, k: int, into: str = "recon"
) -> DataFrame:
    """Project on ``k`` components around the mean and back."""
    model = fit_pca(rows, vector, k)
    cells = rows.select(F.posexplode(vector).alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"))
    mean = np.array([r["m"] for r in cells.orderBy("pos").collect()])
    basis = np.asarray(model.pc.toArray())
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))

    @F.arrow_udf("array<double>")
    def rebuild(column: pa.Array) -> pa.Array:
        mu, pc = shared.value
        x = rows_as_matrix(column)
        out = (x - mu) @ pc @ pc.T + mu
        return matrix_as_rows(out)

    return rows.withColumn(into, rebuild(F.col(vector)))


def array_mse(x: Column, recon: Column) -> Column:
    return array_mean(F.zip_with(x, recon, lambda a, b: (a - b) * (a - b)))


def array_uncertainty(recon: Column) -> Column:
    return array_mean(F.transform(recon, lambda r: 1.0 - F.abs(r - 0.5) * 2.0))


# ---- template matching -----------------------------------------------------


def template_match(
    patches: DataFrame, patch: int, templates: dict[str, np.ndarray], channel: str = "dtm",
    into: str = "template_score",
) -> DataFrame:
    """Best valid cross-correlation over a few templates up to the patch size, by vector lengths."""
    shared = {n: np.asarray(t, dtype=float) for n, t in templates.items()}

    @F.arrow_udf("double")
    def match(column: pa.Array) -> pa.Array:
        x = np.nan_to_num(rows_as_matrix(column), posinf=0.0, neginf=0.0).reshape(-1, patch, patch)
        length = np.sqrt((x * x).sum(axis=(1, 2)))
        best = np.full(len(x), -np.inf)
        kinds = list(shared.values())
        for t, corr in zip(kinds, valid_correlations(x, kinds)):
            score = corr.max(axis=(1, 2)) / (length * np.sqrt((t * t).sum()) + 1e-10)
            best = np.maximum(best, score)
        return pa.array(best)

    return patches.withColumn(into, match(F.col(channel)))
