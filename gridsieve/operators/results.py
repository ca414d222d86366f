"""Summaries, rankings, candidate tables and report rows from patch scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import top_k_per_group
from ..functions.scalars import (
    affine_lat,
    affine_lon,
    interpolate_lat,
    interpolate_lon,
    is_anomaly,
    patch_bounds,
    r4,
    r6,
    verdict,
)
from ..session import attach_small
from .mosaic import area_extent

GATE = "gate_prediction"
MODELS = ("prob_autoencoder", "prob_iforest", "prob_kmeans", "arch_similarity")
HIST_BINS = 50

# Report column names in their published order.
CSV_COLUMNS = (
    "Patch ID",
    "Row",
    "Col",
    "GATE Confidence",
    "Is Anomaly",
    "Autoencoder Score",
    "IForest Score",
    "KMeans Score",
    "Arch Similarity",
)


def _share(part: Column) -> Column:
    """Percent of rows for which ``part`` holds; NULL on empty input."""
    return F.avg(part.cast("double")) * 100


def order_by_score(score: str = GATE) -> list[Column]:
    return [F.desc(score), F.asc("patch_id")]


def detections(scores: DataFrame, threshold: float = 0.5, score: str = GATE) -> DataFrame:
    return scores.where(F.col(score) >= threshold)


def flag_against_threshold(scores: DataFrame, threshold: float, score: str = GATE) -> DataFrame:
    """The strict 0.5 flag next to the reporting threshold; they need not agree."""
    return scores.select(
        "patch_id",
        is_anomaly(F.col(score)).alias("is_anomaly"),
        (F.col(score) >= threshold).alias("detected"),
    )


# ---- rankings --------------------------------------------------------------


def top_candidates(scores: DataFrame, n: int = 20, score: str = GATE) -> DataFrame:
    return scores.orderBy(*order_by_score(score)).limit(n)


def top_per_area(scores: DataFrame, n: int = 20, score: str = GATE) -> DataFrame:
    return top_k_per_group(
        scores, ["aoi"], order_by_score(score), n, ["patch_id"], rank_as="rank"
    )


def top_positive(
    scores: DataFrame, threshold: float = 0.5, n: int = 16, score: str = GATE
) -> DataFrame:
    return top_candidates(detections(scores, threshold, score), n, score)


def ranked(scores: DataFrame, n: int, score: str = GATE) -> DataFrame:
    """Best ``n`` with a 1-based rank; only those ``n`` rows are numbered."""
    return top_candidates(scores, n, score).withColumn(
        "rank", F.row_number().over(W.orderBy(*order_by_score(score)))
    )


# ---- summaries -------------------------------------------------------------


def prediction_summary(
    scores: DataFrame, threshold: float = 0.5, keys: list[str] | None = None, score: str = GATE
) -> DataFrame:
    """Totals, detections and score range; one row, or one per group."""
    s = F.col(score)
    return scores.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_patches"),
        F.count_if(s >= threshold).alias("anomalies_detected"),
        _share(s >= threshold).alias("anomaly_percentage"),
        F.avg(s).alias("mean_confidence"),
        F.max(s).alias("max_confidence"),
        F.min(s).alias("min_confidence"),
    )


def summary_with_top(
    scores: DataFrame, threshold: float = 0.5, n: int = 20, score: str = GATE
) -> DataFrame:
    """Summary per area with its top candidates as an array of structs."""
    top = top_per_area(scores, n, score).groupBy("aoi").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    "rank",
                    "patch_id",
                    "row",
                    "col",
                    F.col(score).alias("confidence"),
                    is_anomaly(F.col(score)).alias("is_anomaly"),
                )
            )
        ).alias("top_candidates")
    )
    return prediction_summary(scores, threshold, ["aoi"], score).join(top, "aoi")


def formatted_statistics(scores: DataFrame, n: int = 10, score: str = GATE) -> DataFrame:
    """The ranked candidates with display rounding."""
    return ranked(scores, n, score).select(
        "rank",
        "patch_id",
        "row",
        "col",
        r4(F.col(score)).alias("confidence"),
        is_anomaly(F.col(score)).alias("is_anomaly"),
    )


def formatted_overview(scores: DataFrame, threshold: float = 0.5, score: str = GATE) -> DataFrame:
    s = prediction_summary(scores, threshold, None, score)
    return s.select(
        "total_patches",
        "anomalies_detected",
        F.round("anomaly_percentage", 2).alias("anomaly_percentage"),
        F.lit(threshold).alias("threshold"),
        r4(F.col("mean_confidence")).alias("mean"),
        r4(F.col("max_confidence")).alias("max"),
        r4(F.col("min_confidence")).alias("min"),
    )


def gate_statistics(
    scores: DataFrame, threshold: float = 0.5, keys: list[str] | None = None, score: str = GATE
) -> DataFrame:
    s = F.col(score)
    return scores.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total_patches"),
        F.count_if(s >= threshold).alias("positive_patches"),
        _share(s >= threshold).alias("positive_percentage"),
        F.avg(s).alias("mean_gate_score"),
        F.max(s).alias("max_gate_score"),
        F.min(s).alias("min_gate_score"),
        F.stddev_pop(s).alias("std_gate_score"),
        F.lit(threshold).alias("threshold"),
    )


def area_batch(scores: DataFrame, start: int, end: int, threshold: float = 0.5) -> DataFrame:
    """Statistics of the areas at positions ``start..end`` of the sorted list."""
    first = scores.select("aoi").distinct().orderBy("aoi").limit(end + 1)
    position = F.row_number().over(W.orderBy("aoi")) - 1
    chosen = first.withColumn("__at", position).where(F.col("__at") >= start).select("aoi")
    picked = scores.join(chosen, "aoi", "left_semi")
    return gate_statistics(picked, threshold, ["aoi"])


def area_info(patches: DataFrame, channels) -> DataFrame:
    """Patch count, pixels per patch and channel count per area."""
    first = channels[0]
    return patches.groupBy("aoi").agg(
        F.count(F.lit(1)).alias("patches"),
        F.max(F.size(first)).alias("patch_pixels"),
        F.lit(len(channels)).alias("channels"),
    )


def score_histogram(scores: DataFrame, bins: int = HIST_BINS, score: str = GATE) -> DataFrame:
    """Equal bins from minimum to maximum, the last one closed; every bin is listed."""
    bounds = scores.agg(F.struct(F.min(score).alias("lo"), F.max(score).alias("hi")).alias("b"))
    at = bounds.scalar()
    spread = F.nullif(at["hi"] - at["lo"], F.lit(0.0))
    place = F.floor((F.col(score) - at["lo"]) / spread * bins)
    counted = (
        scores.where(F.col(score).isNotNull())
        .select(F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
        .groupBy("bin")
        .agg(F.count(F.lit(1)).alias("patches"))
    )
    every = scores.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counted, "bin", "left").select(
        "bin", F.coalesce("patches", F.lit(0)).alias("patches")
    )


def threshold_sweep(scores: DataFrame, thresholds, score: str = GATE) -> DataFrame:
    """Detections per threshold, all counted in one pass."""
    names = {f"t{i}": float(t) for i, t in enumerate(thresholds)}
    counted = scores.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col(score) >= t).alias(n) for n, t in names.items()],
    )
    pairs = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(n).alias("detected")) for n, t in names.items()]
    )
    return counted.select("total", F.explode(pairs).alias("p")).select(
        "p.threshold",
        "p.detected",
        (F.col("p.detected") / F.nullif("total", F.lit(0)) * 100.0).alias("detected_pct"),
    )


def area_rollup(scores: DataFrame, threshold: float = 0.5, score: str = GATE) -> DataFrame:
    """Counts per area plus the grand total (NULL area)."""
    return scores.rollup("aoi").agg(
        F.count(F.lit(1)).alias("total_patches"),
        F.count_if(F.col(score) >= threshold).alias("anomalies_detected"),
        F.avg(score).alias("mean_confidence"),
    )


def processing_summary(inputs: DataFrame, produced: DataFrame) -> DataFrame:
    """Success counts and rate; an area is successful when it produced rows."""
    marked = inputs.select("aoi").distinct().join(
        produced.select("aoi").distinct().withColumn("__ok", F.lit(True)), "aoi", "left"
    )
    ok = F.coalesce(F.col("__ok"), F.lit(False))
    return marked.agg(
        F.count_if(ok).alias("successful"),
        F.count_if(~ok).alias("failed"),
        F.coalesce(_share(ok), F.lit(0.0)).alias("success_rate"),
    )


NO_REASON = "no output"


def area_status(inputs: DataFrame, produced: DataFrame, reasons: DataFrame | None = None) -> DataFrame:
    """(aoi, ok, reason): one row for each area of ``inputs``.

    An area is ok when it produced rows.  ``reasons`` (aoi, reason) says why others failed; an
    area with several has the first by alphabet, one without has ``NO_REASON``.  Rows without
    an area are left out.
    """
    marked = (
        inputs.where("aoi is not null").select("aoi").distinct()
        .join(produced.select("aoi").distinct().withColumn("__ok", F.lit(True)), "aoi", "left")
        .withColumn("ok", F.coalesce("__ok", F.lit(False)))
    )
    if reasons is None:
        found = marked.withColumn("__why", F.lit(None).cast("string"))
    else:
        found = marked.join(reasons.groupBy("aoi").agg(F.min("reason").alias("__why")), "aoi", "left")
    why = F.when(~F.col("ok"), F.coalesce("__why", F.lit(NO_REASON)))
    return found.select("aoi", "ok", why.alias("reason"))


def status_summary(status: DataFrame) -> DataFrame:
    """Counts of successful and failed areas and the success rate in percent; 0 without areas."""
    return status.agg(
        F.count_if("ok").alias("successful"),
        F.count_if(~F.col("ok")).alias("failed"),
        F.coalesce(_share(F.col("ok")), F.lit(0.0)).alias("success_rate"),
    )


def missing_areas(inputs: DataFrame, produced: DataFrame) -> DataFrame:
    """Areas without any output row."""
    return inputs.select("aoi").distinct().join(produced.select("aoi").distinct(), "aoi", "left_anti")


def existing_areas(inputs: DataFrame, produced: DataFrame) -> DataFrame:
    return inputs.select("aoi").distinct().join(produced.select("aoi").distinct(), "aoi", "left_semi")


# ---- located candidates and the multi-area document ------------------------


def with_area_bounds(scores: DataFrame, aoi_meta: DataFrame, patch: int) -> DataFrame:
    """Attach extent and bounds; areas without metadata get zeros."""
    dims = area_extent(scores, patch).join(
        aoi_meta.withColumnRenamed("aoi_id", "aoi").select(
            "aoi", "min_lat", "max_lat", "min_lon", "max_lon"
        ),
        "aoi",
        "left",
    )
    zero = F.lit(0.0)
    dims = dims.withColumns(
        {c: F.coalesce(c, zero) for c in ("min_lat", "max_lat", "min_lon", "max_lon")}
    )
    return attach_small(scores, dims, ["aoi"])


def located_anomalies(
    scores: DataFrame, aoi_meta: DataFrame, patch: int, threshold: float = 0.5, score: str = GATE
) -> DataFrame:
    """Patches at or above the threshold with centre, coordinates and bounds."""
    half = patch // 2
    row, col = F.col("row") + half, F.col("col") + half
    lat = interpolate_lat(row, F.col("height"), F.col("min_lat"), F.col("max_lat"))
    lon = interpolate_lon(col, F.col("width"), F.col("min_lon"), F.col("max_lon"))
    placed = with_area_bounds(scores, aoi_meta, patch).where(F.col(score) >= threshold)
    return placed.select(
        F.col("aoi").alias("aoi_id"),
        "patch_id",
        r4(F.col(score)).alias("confidence"),
        F.struct(r6(lat).alias("lat"), r6(lon).alias("lng")).alias("coordinates"),
        F.struct(row.alias("row"), col.alias("col")).alias("pixel_location"),
        patch_bounds(F.col("row"), F.col("col"), patch).alias("patch_bounds"),
    )


def area_summary(
    scores: DataFrame, aoi_meta: DataFrame, patch: int, threshold: float = 0.5, score: str = GATE
) -> DataFrame:
    """Counts, bounds, centre and anomaly rate of each area."""
    counts = scores.groupBy("aoi").agg(
        F.count(F.lit(1)).alias("total_patches"),
        F.count_if(F.col(score) >= threshold).alias("anomalies_detected"),
    )
    meta = aoi_meta.withColumnRenamed("aoi_id", "aoi").select(
        "aoi", "min_lat", "max_lat", "min_lon", "max_lon"
    )
    zero = F.lit(0.0)
    out = counts.join(meta, "aoi", "left").withColumns(
        {c: F.coalesce(c, zero) for c in ("min_lat", "max_lat", "min_lon", "max_lon")}
    )
    return out.withColumns(
        {
            "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
            "center_lng": (F.col("min_lon") + F.col("max_lon")) / 2,
            "anomaly_rate": F.round(
                F.col("anomalies_detected") / F.col("total_patches") * 100.0, 1
            ),
        }
    )


def document_summary(
    scores: DataFrame, anomalies: DataFrame, threshold: float = 0.5, score: str = GATE
) -> DataFrame:
    """Totals over all areas; the mean is over the rounded anomaly confidences."""
    mean = anomalies.agg(r4(F.avg("confidence")).alias("m")).scalar()
    return scores.agg(
        F.count_distinct("aoi").alias("total_aois"),
        F.count(F.lit(1)).alias("total_patches"),
        F.count_if(F.col(score) >= threshold).alias("anomalies_detected"),
        F.coalesce(F.round(_share(F.col(score) >= threshold), 2), F.lit(0.0)).alias(
            "anomaly_percentage"
        ),
    ).withColumn("mean_confidence", F.coalesce(mean, F.lit(0.0)))


def top_of_document(anomalies: DataFrame, n: int = 50) -> DataFrame:
    return anomalies.orderBy(F.desc("confidence"), "aoi_id", "patch_id").limit(n)


def result_document(
    scores: DataFrame, aoi_meta: DataFrame, patch: int, threshold: float = 0.5
) -> dict[str, DataFrame]:
    """The four parts of the published multi-area document."""
    anomalies = located_anomalies(scores, aoi_meta, patch, threshold)
    return {
        "summary": document_summary(scores, anomalies, threshold),
        "aois": area_summary(scores, aoi_meta, patch, threshold),
        "top_candidates": top_of_document(anomalies),
        "all_anomalies": anomalies,
    }


def map_extent(areas: DataFrame) -> DataFrame:
    """Bounding box over all areas and its centre."""
    box = areas.agg(
        F.min("min_lat").alias("min_lat"),
        F.max("max_lat").alias("max_lat"),
        F.min("min_lon").alias("min_lon"),
        F.max("max_lon").alias("max_lon"),
    )
    return box.withColumns(
        {
            "center_lat": (F.col("min_lat") + F.col("max_lat")) / 2,
            "center_lon": (F.col("min_lon") + F.col("max_lon")) / 2,
        }
    )


# ---- report rows -----------------------------------------------------------


def geojson_features(
    scores: DataFrame,
    patch: int,
    threshold: float = 0.5,
    grids: DataFrame | None = None,
    score: str = GATE,
) -> DataFrame:
    """Feature columns: patch centre as lon/lat (or col/row without a transform)."""
    half = patch // 2
    base = scores.where(F.col(score) >= threshold)
    if grids is None:
        none = F.lit(None).cast("double")
        base = base.withColumns({c: none for c in ("x0", "dx", "y0", "dy")})
    else:
        base = attach_small(base, grids.select("aoi", "x0", "dx", "y0", "dy"), ["aoi"])
    return base.select(
        "patch_id",
        affine_lon(F.col("col") + half, F.col("x0"), F.col("dx")).alias("lon"),
        affine_lat(F.col("row") + half, F.col("y0"), F.col("dy")).alias("lat"),
        r4(F.col(score)).alias("confidence"),
        is_anomaly(F.col(score)).alias("is_anomaly"),
        "row",
        "col",
        *[r4(F.col(m)).alias(m) for m in MODELS],
    )


def geojson_lines(features: DataFrame) -> DataFrame:
    """One GeoJSON feature per line."""
    models = F.struct(
        F.col("prob_autoencoder").alias("autoencoder"),
        F.col("prob_iforest").alias("iforest"),
        F.col("prob_kmeans").alias("kmeans"),
        F.col("arch_similarity").alias("arch_similarity"),
    )
    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias(
            "geometry"
        ),
        F.struct(
            "patch_id", "confidence", "is_anomaly", "row", "col", models.alias("model_scores")
        ).alias("properties"),
    )
    return features.select(F.to_json(feature).alias("value"))


def csv_report(scores: DataFrame, score: str = GATE) -> DataFrame:
    source = ("prob_autoencoder", "prob_iforest", "prob_kmeans", "arch_similarity")
    cells = [F.col("patch_id"), F.col("row"), F.col("col"), r4(F.col(score)), is_anomaly(F.col(score))]
    cells += [r4(F.col(c)) for c in source]
    return scores.select(*[c.alias(n) for c, n in zip(cells, CSV_COLUMNS)])


def json_report(scores: DataFrame, score: str = GATE) -> DataFrame:
    """Nested prediction rows of the JSON report."""
    return scores.select(
        "patch_id",
        F.struct("row", "col").alias("position"),
        r4(F.col(score)).alias("gate_confidence"),
        is_anomaly(F.col(score)).alias("is_anomaly"),
        F.struct(
            r4(F.col("prob_autoencoder")).alias("autoencoder"),
            r4(F.col("prob_iforest")).alias("iforest"),
            r4(F.col("prob_kmeans")).alias("kmeans"),
            r4(F.col("arch_similarity")).alias("arch_similarity"),
        ).alias("model_breakdown"),
    )


def verdict_records(rows: DataFrame) -> DataFrame:
    """Per-patch record of model findings with a readable verdict."""
    return rows.select(
        "patch_id",
        "reconstruction_error",
        "iforest_score",
        "iforest_is_anomaly",
        "cluster_id",
        "cluster_similarity",
        "combined_anomaly_score",
        verdict(F.col("combined_anomaly_score")).alias("verdict"),
    )


# ---- change, context, log --------------------------------------------------


def temporal_change(
    before: DataFrame, after: DataFrame, score: str = GATE, min_delta: float = 0.1
) -> DataFrame:
    """Score change per patch between two periods."""
    a = before.select("patch_id", F.col(score).alias("score_before"))
    b = after.select("patch_id", F.col(score).alias("score_after"))
    delta = F.col("score_after") - F.col("score_before")
    status = (
        F.when(F.col("score_before").isNull(), "new")
        .when(F.col("score_after").isNull(), "gone")
        .when(delta >= min_delta, "increased")
        .when(delta <= -min_delta, "decreased")
        .otherwise("stable")
    )
    return a.join(b, "patch_id", "full_outer").select(
        "patch_id", "score_before", "score_after", delta.alias("delta"), status.alias("status")
    )


def spatial_context(scores: DataFrame, stride: int, score: str = GATE) -> DataFrame:
    """Mean score of the up to eight adjacent patches.

    Every patch sends its score to its neighbours and the patch itself marks
    where they are wanted, so one aggregation does the work of a self-join.
    """
    offsets = [(a, b) for a in (-stride, 0, stride) for b in (-stride, 0, stride)]
    step = F.explode(
        F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in offsets])
    )
    sent = scores.select("aoi", "row", "col", "patch_id", F.col(score).alias("s"), step.alias("k"))
    own = (F.col("k.dr") == 0) & (F.col("k.dc") == 0)
    return (
        sent.groupBy(
            "aoi",
            (F.col("row") + F.col("k.dr")).alias("row"),
            (F.col("col") + F.col("k.dc")).alias("col"),
        )
        .agg(
            F.max(F.when(own, F.col("patch_id"))).alias("patch_id"),
            F.max(F.when(own, F.col("s"))).alias(score),
            F.count_if(~own).alias("neighbours"),
            F.avg(F.when(~own, F.col("s"))).alias("neighbour_mean"),
        )
        .where(F.col("patch_id").isNotNull())
    )


def latest_runs(log: DataFrame, key: str = "id") -> DataFrame:
    """Current state of every run from an append-only log, by partial maximum."""
    rest = [c for c in log.columns if c not in (key, "created_at", "seq")]
    newest = F.max(F.struct("created_at", "seq", *rest)).alias("s")
    return log.groupBy(key).agg(newest).select(key, "s.*")


def run_by_id(log: DataFrame, run_id) -> DataFrame:
    return latest_runs(log.where(F.col("id") == run_id))


def newest_runs(log: DataFrame, n: int | None = None) -> DataFrame:
    out = latest_runs(log).orderBy(F.desc("created_at"), F.desc("seq"))
    return out if n is None else out.limit(n)


def first_demo_run(log: DataFrame) -> DataFrame:
    return latest_runs(log).where("is_demo").orderBy("created_at", "seq").limit(1)
