"""All models of one scoring run in one bundle, applied in one pass over the blocks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...config import CHANNELS, PatchGrid
from ...functions.scalars import minmax_eps
from ...schemas import patch_schema
from ...session import attach_small, settle
from .. import similarity as sim
from ..evaluation import area_bounds
from ..patches import map_patches
from .embedding import _mean_square_gap
from .forest import walk_forest
from .gate import FEATURES, forward

# Sites of one bundle: their matrix goes to every worker, so its size is checked.
MAX_SITE_BYTES = 64 * 1024 * 1024


@dataclass
class ModelBundle:
    """Fitted parameters; every part is bounded by model or geometry, sites by a check.

    ``template`` is the mean patch, (channels, pixels).  ``forest`` is a packed node table (see
    ``pack_forest``) with the ``offset`` of its decisions.  ``mean`` and ``scale`` standardise
    embeddings for the forest and the clusters.  ``centres`` is (k, d), ``sites`` (n, d).
    """

    template: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    forest: dict
    offset: float
    centres: np.ndarray
    sites: np.ndarray
    gate: dict
    members: np.ndarray | None = None  # of each cluster, where the bundle was fitted
    spread: float = field(init=False)

    def __post_init__(self):
        gaps = self.centres[:, None, :] - self.centres[None, :, :]
        self.spread = float(np.sqrt((gaps * gaps).sum(axis=2)).max()) if len(self.centres) else 0.0


def site_matrix(sites: DataFrame, vector: str = "embedding", key: str = "site_idx") -> np.ndarray:
    """The sites as one matrix in order of their index; too many for a worker raise."""
    size = sites.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 > MAX_SITE_BYTES:
        raise ValueError("too many sites for one bundle; use best_match on the embeddings")
    return sim.rows_as_matrix(sites.orderBy(key).select(vector).toArrow().column(vector))


def channel_moments(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, minimum and maximum of each sanitised channel: (n, 4 * channels)."""
    clean = np.nan_to_num(x.reshape(len(x), x.shape[1], -1), posinf=0.0, neginf=0.0)
    parts = clean.mean(2), clean.std(2), clean.min(2), clean.max(2)
    return np.stack(parts, axis=2).reshape(len(x), -1)


def model_scores(x: np.ndarray, bundle: ModelBundle, variant: str) -> dict[str, np.ndarray]:
    """Error, forest decision, cluster and site scores of (n, channels, patch, patch) pixels."""
    flat = x.reshape(len(x), x.shape[1], -1)
    found = {"mse": np.asarray(_mean_square_gap(flat, bundle.template))}
    found["mse"] = found["mse"].astype(float)
    vectors = channel_moments(x)
    found["embedding"] = vectors
    scaled = (vectors - bundle.mean) / bundle.scale
    found["decision"] = walk_forest(scaled, bundle.forest) - bundle.offset
    if variant == "online":
        far = -sim._score(scaled, bundle.centres, "euclidean", 0.0)
        found["cluster"] = far.argmin(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            found["prob_kmeans"] = 1.0 - far.min(axis=1) / (bundle.spread or np.nan)
    else:
        near = sim._score(scaled, bundle.centres, "cosine", sim.EPS_OFFLINE)
        found["cluster"] = near.argmax(axis=1)
        found["prob_kmeans"] = (near.max(axis=1) + 1.0) / 2.0
    eps = sim.EPS_ONLINE if variant == "online" else sim.EPS_OFFLINE
    if len(bundle.sites):
        like = sim._score(vectors, bundle.sites, "cosine", eps)
        found["best_idx"], best = like.argmax(axis=1), like.max(axis=1)
    else:
        found["best_idx"], best = np.full(len(x), -1), np.full(len(x), np.nan)
    if variant == "online":
        found["arch_similarity"] = np.nan_to_num(best, nan=0.0)
    else:
        found["arch_similarity"] = (best + 1.0) / 2.0
    return found


_DOUBLES = ("mse", "decision", "prob_kmeans", "arch_similarity")
_ONLINE = ("prob_autoencoder", "prob_iforest", "gate_prediction")


def fused_scores(
    normal: DataFrame,
    grid: PatchGrid,
    bundle: ModelBundle,
    variant: str = "offline",
    min_valid_ratio: float = 0.7,
    channels=CHANNELS,
    with_embedding: bool = False,
) -> DataFrame:
    """Five scores of every valid patch straight from normalised pixels.

    One pass over the blocks computes embedding, reconstruction error, forest, cluster, site
    and, by the online formulas, GATE score of each patch; no patch and no embedding is stored
    or joined.  The offline formulas scale error and forest score by their area's range, so
    there one narrow row per patch is written first; the ranges are one row per area.

    Rows: aoi, row, col, n_valid, mse, decision, cluster, best_idx (-1 without sites), the five
    scores, and the embedding on request.
    """
    if variant not in ("online", "offline"):
        raise ValueError("variant must be 'online' or 'offline'")
    held = normal.sparkSession.sparkContext.broadcast(bundle)
    doubles = [*_DOUBLES, *(_ONLINE if variant == "online" else ())]
    fields = [T.StructField(c, T.DoubleType()) for c in doubles]
    fields += [T.StructField(c, T.LongType()) for c in ("cluster", "best_idx")]
    if with_embedding:
        fields.append(T.StructField("embedding", T.ArrayType(T.DoubleType())))

    def scored(x: np.ndarray) -> dict[str, pa.Array]:
        found = model_scores(x, held.value, variant)
        vectors = found.pop("embedding")
        if variant == "online":
            with np.errstate(over="ignore"):
                found["prob_autoencoder"] = 1.0 / (1.0 + np.exp(-10.0 * found["mse"]))
                found["prob_iforest"] = 1.0 / (1.0 + np.exp(-found["decision"]))
            features = np.stack([found[c] for c in FEATURES], axis=1)
            found["gate_prediction"] = forward(features, held.value.gate)
        out = {c: pa.array(found[c], pa.float64(), from_pandas=True) for c in doubles}
        out |= {c: pa.array(found[c], pa.int64()) for c in ("cluster", "best_idx")}
        if with_embedding:
            out["embedding"] = sim.matrix_as_rows(vectors)
        return out

    schema = T.StructType(patch_schema(()).fields + fields)
    done = map_patches(normal, grid, scored, schema, min_valid_ratio, channels)
    if variant == "online":
        return done
    done = settle(done, "scored").withColumn("inverted", -F.col("decision"))
    for raw, into in (("mse", "prob_autoencoder"), ("inverted", "prob_iforest")):
        ranged = attach_small(done, area_bounds(done, raw), ["aoi"])
        done = ranged.withColumn(into, minmax_eps(F.col(raw), F.col("lo"), F.col("hi")))
        done = done.drop("lo", "hi")
    gate = F.arrow_udf(_gate_of(held), "double")
    return done.drop("inverted").withColumn("gate_prediction", gate(*FEATURES))


def _gate_of(held):
    def gate(*columns: pa.Array) -> pa.Array:
        features = np.stack([c.to_numpy(zero_copy_only=False) for c in columns], axis=1)
        return pa.array(forward(features.astype(float), held.value.gate), from_pandas=True)

    return gate


def fit_bundle(
    normal: DataFrame,
    grid: PatchGrid,
    sites: np.ndarray,
    gate: dict,
    min_valid_ratio: float = 0.7,
    channels=CHANNELS,
    clusters: int | None = None,
    restarts: int | None = None,
    seed: int = 42,
) -> ModelBundle:
    """Fit template, scaler, forest and clusters on the patches of ``normal``.

    The embeddings, a vector of four moments a channel, are written once; all fits read them.
    """
    from . import clusters as km
    from . import embedding, forest

    mean_of = embedding.mean_patch_of_pixels(normal, grid, min_valid_ratio, channels)
    template = embedding._shared_template(mean_of, channels).value
    moments = lambda x: {"embedding": sim.matrix_as_rows(channel_moments(x))}
    schema = T.StructType(
        patch_schema(()).fields + [T.StructField("embedding", T.ArrayType(T.DoubleType()))]
    )
    rows = map_patches(normal, grid, moments, schema, min_valid_ratio, channels)
    key = F.concat_ws("/", "aoi", "row", "col").alias("key")
    rows = settle(rows.select(key, "embedding"), "embeddings")
    mean, scale = km.scaler_arrays(rows, "embedding")
    fitted = rows.sparkSession.sparkContext.broadcast((mean, scale))

    @F.arrow_udf("array<double>")
    def standard(column: pa.Array) -> pa.Array:
        m, s = fitted.value
        return sim.matrix_as_rows((sim.rows_as_matrix(column, len(m)) - m) / s)

    scaled = settle(rows.select("key", standard("embedding").alias("scaled")), "scaled")
    grown = settle(forest.grow_forest(scaled, "key", "scaled", seed=seed), "forest")
    offset = forest.forest_offset(scaled, grown, "scaled").first()[0]
    fit = km.fit_kmeans(
        scaled, "key", "scaled", clusters or km.CLUSTERS, restarts or km.RESTARTS, seed=seed
    )
    return ModelBundle(
        template, mean, scale, forest.pack_forest(grown), float(offset or 0.0), fit.centres, sites, gate,
        fit.members,
    )
