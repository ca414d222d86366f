"""End-to-end plans: pixels to patches, patches to scores, scores to candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS, PatchGrid
from ..functions.scalars import (
    minmax_eps,
    reconstruction_score,
    sigmoid,
)
from ..operators import channels as ch
from ..operators import patches as pt
from ..operators import similarity as sim
from ..operators import terrain
from ..operators.evaluation import area_bounds
from ..operators.models import clusters, embedding, forest
from ..operators.models.gate import gate_score
from ..session import attach_small, settle


def prepare_pixels(base: DataFrame, clip_percentile=(0.5, 99.5), per_area: int | None = None):
    """Derive terrain channels and normalise all seven; returns pixels and stats.

    The derived pixels are written once: the statistics pass and the extraction
    pass both need them and the neighbourhood shuffle is the costly part.
    """
    full = settle(
        terrain.terrain_derivatives(base, drop_unusable=True).select("aoi", "row", "col", *CHANNELS),
        "channels",
    )
    stats = ch.global_stats(full, CHANNELS, clip_percentile, per_area)
    return ch.normalize_channels(full, stats), stats


def reconstruction_candidates(patches: DataFrame, channels=CHANNELS) -> DataFrame:
    """Score each patch of a patch table by its distance from the mean patch."""
    template = embedding.mean_patch(patches, channels)
    scored = embedding.mean_patch_error(patches, template, channels)
    return scored.drop(*channels).withColumn("score", reconstruction_score(F.col("mse")))


def scored_patches(
    normal: DataFrame, grid: PatchGrid, min_valid_ratio: float = 0.7, channels=CHANNELS
) -> DataFrame:
    """The same scores straight from normalised pixels, with patch ids.

    Patches overlap, so storing them would quadruple the pixels.  Two passes over
    the pixels, one for the mean patch and one for the errors, store nothing but
    one narrow row per patch.
    """
    template = embedding.mean_patch_of_pixels(normal, grid, min_valid_ratio, channels)
    errors = embedding.mean_patch_error_of_pixels(normal, grid, template, min_valid_ratio, channels)
    scored = errors.withColumn("score", reconstruction_score(F.col("mse")))
    return pt.number_rows(settle(scored, "scored"))


def offline_scores(
    patches: DataFrame,
    sites: DataFrame,
    gate: dict,
    key: str = "vec_id",
    vector: str = "embedding",
    restarts: int = clusters.RESTARTS,
) -> DataFrame:
    """Five scores per patch by the offline formulas.

    ``patches`` carries ``prob_autoencoder`` and an embedding.  The forest score is
    inverted and scaled per area, clusters and sites are compared by cosine.
    """
    stats = settle(clusters.scaler_stats(patches, vector), "scaler")
    scaled = settle(clusters.scale_vectors(patches, stats, vector, "scaled"), "scaled")
    grown = settle(forest.grow_forest(scaled, key, "scaled"), "forest")
    raw = forest.raw_scores(scaled, grown, "scaled")
    decided = settle(
        forest.decide(raw, forest.forest_offset(scaled, grown, "scaled")), "decided"
    ).withColumn("inverted", -F.col("decision"))
    decided = attach_small(decided, area_bounds(decided, "inverted"), ["aoi"])
    decided = decided.withColumn(
        "prob_iforest", minmax_eps(F.col("inverted"), F.col("lo"), F.col("hi"))
    ).drop("lo", "hi", "inverted", "score", "decision", "flag")
    model = clusters.fit_kmeans(scaled, key, "scaled", restarts=restarts)
    centres = clusters.centroid_table(patches.sparkSession, model)
    near = sim.cluster_cosine(scaled, centres, key, vector="scaled")
    known = sim.site_similarity(patches, sites, key, "offline", vector=vector)
    out = (
        decided.drop("prob_kmeans", "arch_similarity", "gate_prediction", vector, "scaled")
        .join(near.select(key, "prob_kmeans"), key)
        .join(known.select(key, "arch_similarity"), key)
    )
    return gate_score(out, gate)


def online_scores(
    patches: DataFrame,
    sites: DataFrame,
    grown: DataFrame,
    offset: DataFrame,
    centres: DataFrame,
    gate: dict,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Ensemble result per patch by the online formulas.

    Differs from the offline variant on purpose: the forest decision goes through
    a logistic function without inversion, clusters use distance, sites the raw
    cosine.
    """
    decided = forest.decide(forest.raw_scores(patches, grown, vector), offset)
    decided = decided.withColumn("prob_iforest", sigmoid(F.col("decision")))
    near = sim.cluster_distance(patches, centres, key, vector=vector)
    known = sim.site_similarity(patches, sites, key, "online", vector=vector)
    merged = (
        decided.drop("prob_kmeans", "arch_similarity", "gate_prediction")
        .join(near.select(key, "prob_kmeans"), key)
        .join(known.select(key, "arch_similarity"), key)
    )
    scored = gate_score(merged, gate)
    return scored.select(
        key,
        "aoi",
        "patch_id",
        "row",
        "col",
        "gate_prediction",
        (F.col("gate_prediction") > 0.5).alias("is_anomaly"),
        F.struct(
            F.col("prob_autoencoder").alias("autoencoder"),
            F.col("prob_iforest").alias("iforest"),
            F.col("prob_kmeans").alias("kmeans"),
            "arch_similarity",
        ).alias("model_scores"),
        F.col(vector).alias("embedding"),
    )
