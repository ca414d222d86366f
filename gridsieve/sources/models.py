"""Storing fitted models as tables, and classifiers in Spark ML's own format."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import AnalysisException

from ..operators.models.bundle import ModelBundle

PARTS = ("model", "scaler", "offset")


def save_model(
    path: str, model: DataFrame, scaler: DataFrame | None = None, offset: DataFrame | None = None
) -> None:
    """Forest nodes or cluster centres with the scaler and offset they belong to."""
    for name, rows in zip(PARTS, (model, scaler, offset)):
        if rows is not None:
            rows.write.parquet(f"{path}/{name}")


def load_model(spark: SparkSession, path: str) -> dict[str, DataFrame | None]:
    """All parts of a stored model; a bare table without parts is the model alone."""

    def read(at: str) -> DataFrame | None:
        try:
            return spark.read.parquet(at)
        except AnalysisException:
            return None

    parts = {name: read(f"{path}/{name}") for name in PARTS}
    if parts["model"] is None:
        parts["model"] = spark.read.parquet(path)
    return parts


def save_bundle(spark: SparkSession, bundle: ModelBundle, path: str) -> None:
    """All parameters of a scoring run as one table, a row for each array."""
    arrays = {f: getattr(bundle, f) for f in ("template", "mean", "scale", "centres", "sites")}
    arrays["offset"] = np.array([bundle.offset])
    arrays |= {f"forest.{n}": np.atleast_1d(v) for n, v in bundle.forest.items()}
    for n, part in bundle.gate.items():
        if n in ("weights", "biases"):
            arrays |= {f"gate.{n}.{i}": np.asarray(a) for i, a in enumerate(part)}
        else:
            arrays[f"gate.{n}"] = np.asarray(part)
    rows = [
        (name, [int(x) for x in a.shape], [float(x) for x in np.asarray(a, float).ravel()])
        for name, a in arrays.items()
    ]
    schema = "name string, shape array<int>, cells array<double>"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def load_bundle(spark: SparkSession, path: str) -> ModelBundle:
    """The bundle that ``save_bundle`` stored; its size is fixed by the models."""
    found = {
        r["name"]: np.array(r["cells"], dtype=float).reshape(r["shape"])
        for r in spark.read.parquet(path).collect()
    }
    forest = {n[7:]: a for n, a in found.items() if n.startswith("forest.")}
    for n in ("roots", "feature", "left", "right", "size"):
        forest[n] = forest[n].astype(np.int64)
    forest["scale"] = float(forest["scale"][0])
    gate = {n: found[f"gate.{n}"] for n in ("mean", "scale")}
    for n in ("weights", "biases"):
        depth = sum(name.startswith(f"gate.{n}.") for name in found)
        gate[n] = [found[f"gate.{n}.{i}"] for i in range(depth)]
    plain = [found[f] for f in ("template", "mean", "scale")]
    return ModelBundle(
        *plain, forest, float(found["offset"][0]), found["centres"], found["sites"], gate
    )


def save_classifier(model: PipelineModel, path: str) -> None:
    model.write().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)
