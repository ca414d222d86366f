"""Batch-gradient training of the stacked classifier's rectified network."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...session import settle, temporary_tables
from .gate import FEATURES, LAYERS
from .partials import merged

# The usual decay rates and floor of Adam.
FIRST_DECAY, SECOND_DECAY, FLOOR = 0.9, 0.999, 1e-8


def sizes(layers=LAYERS) -> list[tuple[int, int]]:
    """(rows, columns) of every layer's matrix."""
    return [(out, into) for into, out in zip(layers, layers[1:])]


def start_weights(seed: int, layers=LAYERS) -> np.ndarray:
    """Flat parameters: normal weights scaled for rectified layers, zero biases."""
    rng = np.random.default_rng(seed)
    parts = []
    for out, into in sizes(layers):
        parts += [rng.normal(size=out * into) * np.sqrt(2.0 / into), np.zeros(out)]
    return np.concatenate(parts)


def unpacked(flat: np.ndarray, layers=LAYERS) -> list[tuple[np.ndarray, np.ndarray]]:
    """(matrix, bias) of every layer, as views of the flat parameters."""
    made, at = [], 0
    for out, into in sizes(layers):
        matrix = flat[at : at + out * into].reshape(out, into)
        at += out * into
        made.append((matrix, flat[at : at + out]))
        at += out
    return made


def loss_and_gradient(
    flat: np.ndarray, x: np.ndarray, y: np.ndarray, layers=LAYERS
) -> tuple[float, np.ndarray]:
    """Summed cross-entropy of scaled rows ``x`` and its gradient by the flat parameters."""
    net = unpacked(flat, layers)
    inputs, signal = [], x
    for k, (matrix, bias) in enumerate(net):
        inputs.append(signal)
        signal = signal @ matrix.T + bias
        if k < len(net) - 1:
            signal = np.maximum(signal, 0.0)
    z = signal[:, 0]
    loss = float((np.logaddexp(0.0, z) - y * z).sum())
    back = (0.5 * (1.0 + np.tanh(0.5 * z)) - y)[:, None]
    parts = []
    for k in range(len(net) - 1, -1, -1):
        parts += [back.sum(axis=0), (back.T @ inputs[k]).ravel()]
        if k:
            back = (back @ net[k][0]) * (inputs[k] > 0)
    return loss, np.concatenate(parts[::-1])


def _columns(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)


def _scaler(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, population deviation) of the first ``width`` columns.

    Two passes, so that features far from zero keep their digits; a constant feature has
    scale 1.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            x = _columns(batch)[:, :width]
            part = np.concatenate(([len(x)], x.sum(axis=0)))
            out = part if out is None else out + part
        return out

    first = merged(rows, sums)
    if first is None:
        return 0, np.zeros(width), np.ones(width)
    n, mean = int(first[0]), first[1:] / first[0]

    def squares(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        out = None
        for batch in batches:
            part = ((_columns(batch)[:, :width] - mean) ** 2).sum(axis=0)
            out = part if out is None else out + part
        return out

    deviation = np.sqrt(merged(rows, squares) / n)
    return n, mean, np.where(deviation > 0, deviation, 1.0)


def fit_network(
    train: DataFrame,
    label: str = "label",
    features=FEATURES,
    layers=LAYERS,
    seed: int = 42,
    rounds: int = 200,
    rate: float = 0.05,
    shrink: float = 1e-4,
    tolerance: float = 1e-6,
) -> dict | None:
    """Weights, biases, mean and scale for ``gate_score``, with the loss of every round.

    The scaler uses the population deviation.  A round is one pass over all rows: the summed
    loss and gradient of each task are added up in a fixed number of further tasks, and the
    driver takes one Adam step on a vector whose length the network fixes.  ``shrink`` is the
    squared penalty on all parameters; training ends early when the loss moves by less than
    ``tolerance`` of itself, and the best round's parameters are kept.

    Rows with a null or not finite feature or label are not used.  Without rows: None.
    """
    if layers[0] != len(features) or layers[-1] != 1:
        raise ValueError("the network needs one input for each feature and one output")
    spark = train.sparkSession
    names = [f"x{k}" for k in range(len(features))]
    cells = [F.col(f).cast("double").alias(n) for f, n in zip(features, names)]
    rows = train.select(*cells, F.col(label).cast("double").alias("y"))
    real = [F.col(c).isNotNull() & (F.abs(F.col(c)) < float("inf")) for c in (*names, "y")]
    usable = real[0]
    for test in real[1:]:
        usable = usable & test
    with temporary_tables(spark):
        held = settle(rows.where(usable), "gate-rows")
        n, mean, scale = _scaler(held, len(features))
        if not n:
            return None
        flat = start_weights(seed, layers)
        first, second = np.zeros_like(flat), np.zeros_like(flat)
        losses, best = [], flat
        for step in range(1, rounds + 1):

            def partial(batches: Iterator[pa.RecordBatch], flat=flat) -> np.ndarray | None:
                out = None
                for batch in batches:
                    table = _columns(batch)
                    x, y = (table[:, :-1] - mean) / scale, table[:, -1]
                    loss, gradient = loss_and_gradient(flat, x, y, layers)
                    part = np.concatenate(([loss], gradient))
                    out = part if out is None else out + part
                return out

            found = merged(held, partial) / n
            loss = float(found[0] + 0.5 * shrink * flat @ flat)
            if not losses or loss < min(losses):
                best = flat
            losses.append(loss)
            if len(losses) > 1 and abs(losses[-2] - loss) <= tolerance * abs(loss):
                break
            gradient = found[1:] + shrink * flat
            first = FIRST_DECAY * first + (1 - FIRST_DECAY) * gradient
            second = SECOND_DECAY * second + (1 - SECOND_DECAY) * gradient**2
            ahead = first / (1 - FIRST_DECAY**step)
            spread = np.sqrt(second / (1 - SECOND_DECAY**step))
            flat = flat - rate * ahead / (spread + FLOOR)
    net = unpacked(best, layers)
    return {
        "weights": [m.tolist() for m, _ in net],
        "biases": [b.tolist() for _, b in net],
        "mean": mean.tolist(),
        "scale": scale.tolist(),
        "losses": losses,
        "rows": n,
    }
