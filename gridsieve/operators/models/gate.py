"""Stacked classifier over the four model scores."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEATURES = ("prob_autoencoder", "prob_iforest", "prob_kmeans", "arch_similarity")
LAYERS = (4, 16, 8, 1)


def demo_weights() -> dict:
    """Small deterministic network for checks; no trained weights are shipped."""

    def value(layer: int, i: int, j: int) -> float:
        return round(math.sin(1.0 + 7 * layer + 3 * i + 5 * j), 3)

    weights, biases = [], []
    for n, (width_in, width_out) in enumerate(zip(LAYERS, LAYERS[1:])):
        weights.append([[value(n, i, j) for j in range(width_in)] for i in range(width_out)])
        biases.append([value(n, i, width_in) / 4 for i in range(width_out)])
    return {"weights": weights, "biases": biases, "mean": [0.5] * 4, "scale": [0.25] * 4}


def forward(features: np.ndarray, model: dict) -> np.ndarray:
    """Probability of every row: scaler, rectified layers, logistic output."""
    x = (features - np.asarray(model["mean"])) / np.asarray(model["scale"])
    layers = list(zip(model["weights"], model["biases"]))
    for n, (matrix, bias) in enumerate(layers):
        x = x @ np.asarray(matrix, dtype=float).T + np.asarray(bias, dtype=float)
        if n < len(layers) - 1:
            x = np.maximum(x, 0.0)
    with np.errstate(over="ignore"):
        return 1.0 / (1.0 + np.exp(-x[:, 0]))


def gate_score(
    scores: DataFrame, model: dict, features=FEATURES, into: str = "gate_prediction",
    binary: bool = False,
) -> DataFrame:
    """Add the network's probability: scaler, two rectified layers, logistic output.

    One pass in Arrow batches; a row with a missing score gets NULL.  ``binary`` reports 0/1
    at 0.5 instead of the probability.
    """
    held = scores.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def network(*columns: pa.Array) -> pa.Array:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns], axis=1)
        return pa.array(forward(x, held.value), from_pandas=True)

    p = network(*[F.col(c).cast("double") for c in features[: len(model["mean"])]])
    return scores.withColumn(into, (p > 0.5).cast("double") if binary else p)


def fit_gate(
    train: DataFrame, label: str = "label", kind: str = "mlp", seed: int = 42, max_iter: int = 1000
):
    """Fit scaler and classifier on labelled score rows; returns a fitted ML model."""
    stages = [
        VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True),
    ]
    if kind == "mlp":
        stages.append(
            MultilayerPerceptronClassifier(
                layers=[4, 16, 8, 2], labelCol=label, seed=seed, maxIter=max_iter
            )
        )
    elif kind == "logistic":
        stages.append(LogisticRegression(labelCol=label, maxIter=max_iter))
    else:
        raise ValueError("kind must be 'mlp' or 'logistic'")
    return Pipeline(stages=stages).fit(train)


def apply_gate(model, scores: DataFrame, into: str = "gate_prediction") -> DataFrame:
    """Probability of the positive class from a fitted model."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(scores)
    return scored.withColumn(into, vector_to_array("probability")[1]).drop(
        "raw_features", "features", "rawPrediction", "probability", "prediction"
    )
