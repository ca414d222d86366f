"""Queries on patch scores: expressions, rankings, summaries, reports, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as fx
from ..operators import evaluation as ev
from ..operators import quality, splits
from ..operators import results as rs
from ..operators.models.gate import demo_weights, gate_score
from ..session import attach_small
from ..sources import readers
from . import tables as tb
from .registry import EXTENT, META, PX, SC, compose, gate_ctes, query, rounded, unpivot_sql

scores = tb.scores_only


# ---- expressions -----------------------------------------------------------


@query(
    "sigmoid_score",
    compose([], "SELECT vec_id, 1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))) AS score FROM embeddings",
            "vec_id", "score"),
)
def sigmoid_score(spark, sf):
    e = tb.table(spark, sf, "embeddings")
    x = F.col("embedding")[0].cast("double")
    return rounded(e.select("vec_id", fx.sigmoid(x).alias("score")))


@query(
    "minmax_eps",
    compose([SC], "SELECT patch_id, (prob_autoencoder - min(prob_autoencoder) OVER w) / "
            "(max(prob_autoencoder) OVER w - min(prob_autoencoder) OVER w + 1e-10) AS scaled "
            "FROM sc WINDOW w AS (PARTITION BY aoi)", "patch_id", "scaled"),
)
def minmax_eps(spark, sf):
    s = scores(spark, sf)
    with_bounds = attach_small(s, ev.area_bounds(s, "prob_autoencoder"), ["aoi"])
    scaled = fx.minmax_eps(F.col("prob_autoencoder"), F.col("lo"), F.col("hi"))
    return rounded(with_bounds.select("patch_id", scaled.alias("scaled")))


@query(
    "minmax_guarded",
    compose(
        [SC, "b AS (SELECT *, CASE WHEN aoi = 'AOI_0001' THEN 0.25 ELSE prob_iforest END AS x FROM sc)",
         "m AS (SELECT *, min(x) OVER w AS lo, max(x) OVER w AS hi FROM b WINDOW w AS (PARTITION BY aoi))"],
        "SELECT patch_id, CASE WHEN hi - lo < 1e-10 THEN 0 ELSE (x - lo) / (hi - lo) END AS scaled FROM m",
        "patch_id", "scaled",
    ),
)
def minmax_guarded(spark, sf):
    """One area is made flat and must come out as zeros."""
    x = F.when(F.col("aoi") == "AOI_0001", 0.25).otherwise(F.col("prob_iforest"))
    s = scores(spark, sf).withColumn("x", x)
    with_bounds = attach_small(s, ev.area_bounds(s, "x"), ["aoi"])
    scaled = fx.minmax_guarded(F.col("x"), F.col("lo"), F.col("hi"))
    return rounded(with_bounds.select("patch_id", scaled.alias("scaled")))


@query(
    "standardize",
    compose([SC], "SELECT patch_id, (gate_prediction - avg(gate_prediction) OVER ()) / "
            "stddev_pop(gate_prediction) OVER () AS z FROM sc", "patch_id", "z"),
)
def standardize(spark, sf):
    s = scores(spark, sf)
    at = s.agg(
        F.struct(F.avg("gate_prediction").alias("m"), F.stddev_pop("gate_prediction").alias("s")).alias("b")
    ).scalar()
    z = fx.standardize(F.col("gate_prediction"), at["m"], at["s"])
    return rounded(s.select("patch_id", z.alias("z")))


@query(
    "binarize",
    compose([SC], "SELECT patch_id, CASE WHEN gate_prediction > 0.5 THEN 1 ELSE 0 END AS label FROM sc",
            "patch_id, label"),
)
def binarize(spark, sf):
    return scores(spark, sf).select("patch_id", fx.binarize(F.col("gate_prediction")).alias("label"))


@query(
    "verdicts",
    compose(
        [SC],
        "SELECT patch_id, prob_autoencoder AS reconstruction_error, prob_iforest AS iforest_score, "
        "prob_iforest > 0.5 AS iforest_is_anomaly, label AS cluster_id, prob_kmeans AS cluster_similarity, "
        "gate_prediction AS combined_anomaly_score, CASE WHEN gate_prediction > 0.7 THEN "
        "'HIGH ANOMALY LIKELIHOOD - Investigate!' WHEN gate_prediction > 0.5 THEN "
        "'MODERATE ANOMALY - Worth checking' ELSE 'LIKELY NORMAL TERRAIN' END AS verdict FROM sc",
        "patch_id, iforest_is_anomaly, cluster_id, verdict",
        "reconstruction_error, iforest_score, cluster_similarity, combined_anomaly_score",
    ),
)
def verdicts(spark, sf):
    s = tb.patch_scores(spark, sf)
    rows = s.select(
        "patch_id",
        F.col("prob_autoencoder").alias("reconstruction_error"),
        F.col("prob_iforest").alias("iforest_score"),
        fx.is_anomaly(F.col("prob_iforest")).alias("iforest_is_anomaly"),
        F.col("label").alias("cluster_id"),
        F.col("prob_kmeans").alias("cluster_similarity"),
        F.col("gate_prediction").alias("combined_anomaly_score"),
    )
    return rounded(rs.verdict_records(rows))


@query(
    "confidence_tiers",
    compose(
        [SC],
        "SELECT patch_id, CASE WHEN gate_prediction >= 0.95 THEN 'critical' WHEN gate_prediction >= 0.9 "
        "THEN 'high' WHEN gate_prediction >= 0.8 THEN 'elevated' ELSE 'low' END AS map_tier, "
        "CASE WHEN gate_prediction >= 0.9 THEN 'red' WHEN gate_prediction >= 0.7 THEN 'orange' "
        "WHEN gate_prediction >= 0.5 THEN 'yellow' ELSE 'green' END AS detail_tier, "
        "CASE WHEN gate_prediction > 0.7 THEN 'red' WHEN gate_prediction > 0.5 THEN 'orange' "
        "ELSE 'yellow' END AS border_tier FROM sc",
        "patch_id, map_tier, detail_tier, border_tier",
    ),
)
def confidence_tiers(spark, sf):
    p = F.col("gate_prediction")
    return scores(spark, sf).select(
        "patch_id",
        fx.map_tier(p).alias("map_tier"),
        fx.detail_tier(p).alias("detail_tier"),
        fx.border_tier(p).alias("border_tier"),
    )


@query(
    "pixel_to_latlon",
    compose(
        [SC, EXTENT, META],
        "SELECT patch_id, coalesce(max_lat, 0) - (row + 32) / CAST(height AS DOUBLE) * "
        "(coalesce(max_lat, 0) - coalesce(min_lat, 0)) AS lat, coalesce(min_lon, 0) + (col + 32) / "
        "CAST(width AS DOUBLE) * (coalesce(max_lon, 0) - coalesce(min_lon, 0)) AS lng "
        "FROM sc JOIN extent USING (aoi) LEFT JOIN meta USING (aoi)",
        "patch_id", "lat, lng",
    ),
)
def pixel_to_latlon(spark, sf):
    s = rs.with_area_bounds(scores(spark, sf), tb.score_metadata(spark, sf), 64)
    row, col = F.col("row") + 32, F.col("col") + 32
    return rounded(
        s.select(
            "patch_id",
            fx.interpolate_lat(row, F.col("height"), F.col("min_lat"), F.col("max_lat")).alias("lat"),
            fx.interpolate_lon(col, F.col("width"), F.col("min_lon"), F.col("max_lon")).alias("lng"),
        )
    )


GRIDS = """grids AS (SELECT DISTINCT aoi, -55.0 + CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) * 0.01 AS x0,
  0.00009 AS dx, -3.391 + CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) * 0.01 AS y0, -0.00009 AS dy
  FROM sc WHERE aoi <> 'AOI_0003')"""


def _grids(spark, sf):
    """Affine transform of every area but one, which falls back to pixel positions."""
    i = fx.aoi_index(F.col("aoi")) * 0.01
    areas = scores(spark, sf).select("aoi").distinct().where("aoi <> 'AOI_0003'")
    return areas.select(
        "aoi",
        (i - 55.0).alias("x0"),
        F.lit(0.00009).alias("dx"),
        (i - 3.391).alias("y0"),
        F.lit(-0.00009).alias("dy"),
    )


@query(
    "affine_latlon",
    compose(
        [SC, GRIDS],
        "SELECT patch_id, coalesce(y0 + (row + 0.5) * dy, row) AS lat, coalesce(x0 + (col + 0.5) * dx, col) "
        "AS lng FROM sc LEFT JOIN grids USING (aoi)",
        "patch_id", "lat, lng",
    ),
)
def affine_latlon(spark, sf):
    s = attach_small(scores(spark, sf), _grids(spark, sf), ["aoi"])
    return rounded(
        s.select(
            "patch_id",
            fx.affine_lat(F.col("row"), F.col("y0"), F.col("dy")).alias("lat"),
            fx.affine_lon(F.col("col"), F.col("x0"), F.col("dx")).alias("lng"),
        )
    )


# ---- filters and lookups ---------------------------------------------------


@query(
    "detections",
    compose([SC], "SELECT patch_id, gate_prediction FROM sc WHERE gate_prediction >= 0.6",
            "patch_id", "gate_prediction"),
)
def detections(spark, sf):
    return rounded(rs.detections(scores(spark, sf), 0.6).select("patch_id", "gate_prediction"))


@query(
    "confidence_filter",
    compose(
        [SC, "z AS (SELECT patch_id, (gate_prediction - min(gate_prediction) OVER ()) / "
         "(max(gate_prediction) OVER () - min(gate_prediction) OVER () + 1e-10) AS confidence FROM sc)"],
        "SELECT * FROM z WHERE confidence >= 0.9", "patch_id", "confidence",
    ),
)
def confidence_filter(spark, sf):
    """The interactive default of 0.9, on scores scaled to the unit range."""
    s = scores(spark, sf)
    at = s.agg(
        F.struct(F.min("gate_prediction").alias("lo"), F.max("gate_prediction").alias("hi")).alias("b")
    ).scalar()
    scaled = fx.minmax_eps(F.col("gate_prediction"), at["lo"], at["hi"])
    return rounded(rs.detections(s.select("patch_id", scaled.alias("confidence")), 0.9, "confidence"))


@query(
    "flag_vs_threshold",
    compose([SC], "SELECT patch_id, gate_prediction > 0.5 AS is_anomaly, gate_prediction >= 0.6 AS detected FROM sc",
            "patch_id, is_anomaly, detected"),
)
def flag_vs_threshold(spark, sf):
    return rs.flag_against_threshold(scores(spark, sf), 0.6)


FIVE = "prob_autoencoder, prob_iforest, prob_kmeans, arch_similarity, gate_prediction"


@query(
    "patch_scores_lookup",
    compose([SC], "SELECT * FROM sc WHERE aoi = 'AOI_0003' AND patch_id = 'AOI_0003_p042'",
            "aoi, patch_id, row, col", FIVE),
)
def patch_scores_lookup(spark, sf):
    found = scores(spark, sf).where("aoi = 'AOI_0003' AND patch_id = 'AOI_0003_p042'")
    return rounded(found.select("aoi", "patch_id", "row", "col", *FIVE.split(", ")))


# ---- joins -----------------------------------------------------------------


@query(
    "default_patch_ids",
    compose(
        [SC],
        "SELECT s.vec_id AS ordinal, coalesce(m.patch_id, 'p' || s.vec_id) AS patch_id, s.gate_prediction "
        "FROM sc s LEFT JOIN (SELECT vec_id, patch_id FROM sc WHERE label <> 3) m ON m.vec_id = s.vec_id",
        "ordinal, patch_id", "gate_prediction",
    ),
)
def default_patch_ids(spark, sf):
    s = tb.patch_scores(spark, sf).withColumnRenamed("vec_id", "ordinal")
    metadata = s.where("label <> 3").select("ordinal", "patch_id")
    named = readers.with_default_patch_ids(s.select("ordinal", "gate_prediction"), metadata)
    return rounded(named.select("ordinal", "patch_id", "gate_prediction"))


@query(
    "pred_with_meta",
    compose([SC], f"SELECT * FROM sc", "patch_id, aoi, row, col", FIVE),
)
def pred_with_meta(spark, sf):
    """Predictions and metadata kept apart and joined on the patch."""
    s = scores(spark, sf)
    predictions = s.select("patch_id", *FIVE.split(", "))
    metadata = s.select("patch_id", "aoi", "row", "col")
    return rounded(predictions.join(metadata, "patch_id"))


ANOMALY = (
    "SELECT aoi AS aoi_id, patch_id, round(gate_prediction, 4) AS confidence, "
    "coalesce(max_lat, 0) - (row + 32) / CAST(height AS DOUBLE) * (coalesce(max_lat, 0) - coalesce(min_lat, 0)) AS lat, "
    "coalesce(min_lon, 0) + (col + 32) / CAST(width AS DOUBLE) * (coalesce(max_lon, 0) - coalesce(min_lon, 0)) AS lng, "
    "row + 32 AS center_row, col + 32 AS center_col, row AS row_start, row + 64 AS row_end, "
    "col AS col_start, col + 64 AS col_end FROM sc JOIN extent USING (aoi) LEFT JOIN meta USING (aoi) "
    "WHERE gate_prediction >= 0.5"
)
ANOMALY_PLAIN = "aoi_id, patch_id, center_row, center_col, row_start, row_end, col_start, col_end"


def _flat_anomalies(rows):
    return rows.select(
        "aoi_id",
        "patch_id",
        "confidence",
        F.col("coordinates.lat").alias("lat"),
        F.col("coordinates.lng").alias("lng"),
        F.col("pixel_location.row").alias("center_row"),
        F.col("pixel_location.col").alias("center_col"),
        "patch_bounds.*",
    )


def _anomalies(spark, sf):
    return rs.located_anomalies(scores(spark, sf), tb.score_metadata(spark, sf), 64)


@query(
    "extract_anomalies",
    compose([SC, EXTENT, META], ANOMALY, ANOMALY_PLAIN, "confidence, lat, lng"),
)
def extract_anomalies(spark, sf):
    return _flat_anomalies(_anomalies(spark, sf))


@query(
    "missing_aois",
    compose([SC, PX], "SELECT DISTINCT aoi, aoi NOT IN (SELECT aoi FROM px) AS missing FROM sc", "aoi, missing"),
)
def missing_aois(spark, sf):
    """Score areas partitioned into those with and without pixels."""
    s, px = scores(spark, sf), tb.pixels(spark, sf).select("aoi")
    gone = rs.missing_areas(s, px).withColumn("missing", F.lit(True))
    there = rs.existing_areas(s, px).withColumn("missing", F.lit(False))
    return gone.unionByName(there)


@query(
    "aoi_meta_defaults",
    compose(
        [SC, META],
        "SELECT aoi, coalesce(min_lat, 0) AS min_lat, coalesce(max_lat, 0) AS max_lat, "
        "coalesce(min_lon, 0) AS min_lon, coalesce(max_lon, 0) AS max_lon "
        "FROM (SELECT DISTINCT aoi FROM sc) LEFT JOIN meta USING (aoi)",
        "aoi", "min_lat, max_lat, min_lon, max_lon",
    ),
)
def aoi_meta_defaults(spark, sf):
    areas = scores(spark, sf).select("aoi").distinct()
    return rounded(readers.metadata_or_zero(areas, tb.score_metadata(spark, sf)))


# ---- rankings --------------------------------------------------------------

RANKED = "SELECT *, row_number() OVER (ORDER BY gate_prediction DESC, patch_id) AS rank FROM sc"


@query(
    "top20",
    compose([SC, f"r AS ({RANKED})"], "SELECT * FROM r WHERE rank <= 20",
            "patch_id, row, col", "gate_prediction"),
)
def top20(spark, sf):
    top = rs.top_candidates(scores(spark, sf), 20)
    return rounded(top.select("patch_id", "row", "col", "gate_prediction"))


@query(
    "top_n_accessor",
    compose([SC, f"r AS ({RANKED})"], "SELECT * FROM r WHERE rank <= 7", "patch_id", "gate_prediction"),
)
def top_n_accessor(spark, sf):
    return rounded(rs.top_candidates(scores(spark, sf), 7).select("patch_id", "gate_prediction"))


@query(
    "top20_per_aoi",
    compose(
        [SC, "r AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY gate_prediction DESC, patch_id) AS rank FROM sc)"],
        "SELECT * FROM r WHERE rank <= 20", "aoi, rank, patch_id", "gate_prediction",
    ),
)
def top20_per_aoi(spark, sf):
    top = rs.top_per_area(scores(spark, sf), 20)
    return rounded(top.select("aoi", "rank", "patch_id", "gate_prediction"))


@query(
    "top50_candidates",
    compose([SC, EXTENT, META, f"a AS ({ANOMALY})"],
            "SELECT * FROM a ORDER BY confidence DESC, aoi_id, patch_id LIMIT 50",
            ANOMALY_PLAIN, "confidence, lat, lng"),
)
def top50_candidates(spark, sf):
    return _flat_anomalies(rs.top_of_document(_anomalies(spark, sf), 50))


@query(
    "top_positive",
    compose([SC, f"r AS ({RANKED})"], "SELECT * FROM r WHERE gate_prediction >= 0.5 AND rank <= 16",
            "patch_id, row, col", "gate_prediction"),
)
def top_positive(spark, sf):
    top = rs.top_positive(scores(spark, sf), 0.5, 16)
    return rounded(top.select("patch_id", "row", "col", "gate_prediction"))


@query(
    "formatted_stats",
    compose([SC, f"r AS ({RANKED})"],
            "SELECT rank, patch_id, row, col, round(gate_prediction, 4) AS confidence, "
            "gate_prediction > 0.5 AS is_anomaly FROM r WHERE rank <= 10",
            "rank, patch_id, row, col, is_anomaly", "confidence"),
)
def formatted_stats(spark, sf):
    return rs.formatted_statistics(scores(spark, sf), 10)


@query(
    "formatted_overview",
    compose(
        [SC],
        "SELECT count(*) AS total_patches, count(*) FILTER (WHERE gate_prediction >= 0.5) AS anomalies_detected, "
        "round(avg(CASE WHEN gate_prediction >= 0.5 THEN 1.0 ELSE 0.0 END) * 100, 2) AS anomaly_percentage, "
        "0.5 AS threshold, round(avg(gate_prediction), 4) AS mean, round(max(gate_prediction), 4) AS max, "
        "round(min(gate_prediction), 4) AS min FROM sc",
        "total_patches, anomalies_detected", "anomaly_percentage, threshold, mean, max, min",
    ).replace("0.5 AS threshold", "CAST(0.5 AS DOUBLE) AS threshold"),
)
def formatted_overview(spark, sf):
    return rs.formatted_overview(scores(spark, sf))


# ---- summaries -------------------------------------------------------------

HITS = "count(*) FILTER (WHERE gate_prediction >= 0.5)"
SHARE = "avg(CASE WHEN gate_prediction >= 0.5 THEN 1.0 ELSE 0.0 END) * 100"


@query(
    "prediction_summary",
    compose([SC], f"SELECT count(*) AS total_patches, {HITS} AS anomalies_detected, {SHARE} AS anomaly_percentage, "
            "avg(gate_prediction) AS mean_confidence, max(gate_prediction) AS max_confidence, "
            "min(gate_prediction) AS min_confidence FROM sc",
            "total_patches, anomalies_detected",
            "anomaly_percentage, mean_confidence, max_confidence, min_confidence"),
)
def prediction_summary(spark, sf):
    return rounded(rs.prediction_summary(scores(spark, sf)))


@query(
    "aoi_prediction_summary",
    compose(
        [SC, "r AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY gate_prediction DESC, patch_id) AS rank FROM sc)"],
        f"SELECT aoi, count(*) AS total_patches, {HITS} AS anomalies_detected, {SHARE} AS anomaly_percentage, "
        "avg(gate_prediction) AS mean_confidence, max(gate_prediction) AS max_confidence, "
        "min(gate_prediction) AS min_confidence, count(*) FILTER (WHERE rank <= 20) AS top_n, "
        "max(CASE WHEN rank = 1 THEN patch_id END) AS first_patch, "
        "max(CASE WHEN rank = 20 THEN patch_id END) AS last_patch FROM r GROUP BY aoi",
        "aoi, total_patches, anomalies_detected, top_n, first_patch, last_patch",
        "anomaly_percentage, mean_confidence, max_confidence, min_confidence",
    ),
)
def aoi_prediction_summary(spark, sf):
    """Per-area summary; its top-20 array is reported by length and both ends."""
    s = rs.summary_with_top(scores(spark, sf))
    top = F.col("top_candidates")
    return rounded(
        s.withColumns(
            {
                "top_n": F.size(top).cast("long"),
                "first_patch": top[0]["patch_id"],
                "last_patch": F.try_element_at(top, F.lit(20))["patch_id"],
            }
        ).drop("top_candidates")
    )


GATE = (
    f"count(*) AS total_patches, {HITS} AS positive_patches, {SHARE} AS positive_percentage, "
    "avg(gate_prediction) AS mean_gate_score, max(gate_prediction) AS max_gate_score, "
    "min(gate_prediction) AS min_gate_score, stddev_pop(gate_prediction) AS std_gate_score, "
    "CAST(0.5 AS DOUBLE) AS threshold"
)
GATE_ROUND = (
    "positive_percentage, mean_gate_score, max_gate_score, min_gate_score, std_gate_score, threshold"
)


@query("gate_stats", compose([SC], f"SELECT {GATE} FROM sc", "total_patches, positive_patches", GATE_ROUND))
def gate_stats(spark, sf):
    return rounded(rs.gate_statistics(scores(spark, sf)))


@query(
    "aoi_batch_stats",
    compose(
        [SC, "a AS (SELECT aoi, row_number() OVER (ORDER BY aoi) - 1 AS pos FROM (SELECT DISTINCT aoi FROM sc))"],
        f"SELECT aoi, {GATE} FROM sc WHERE aoi IN (SELECT aoi FROM a WHERE pos BETWEEN 1 AND 3) GROUP BY aoi",
        "aoi, total_patches, positive_patches", GATE_ROUND,
    ),
)
def aoi_batch_stats(spark, sf):
    return rounded(rs.area_batch(scores(spark, sf), 1, 3))


@query(
    "demo_summary",
    compose([SC],
            f"SELECT count(DISTINCT aoi) AS total_aois, count(*) AS total_patches, {HITS} AS anomalies_detected, "
            f"round({SHARE}, 2) AS anomaly_percentage, round(avg(CASE WHEN gate_prediction >= 0.5 THEN "
            "round(gate_prediction, 4) END), 4) AS mean_confidence FROM sc",
            "total_aois, total_patches, anomalies_detected", "anomaly_percentage, mean_confidence"),
)
def demo_summary(spark, sf):
    return rs.document_summary(scores(spark, sf), _anomalies(spark, sf))


AREAS = (
    f"SELECT aoi, count(*) AS total_patches, {HITS} AS anomalies_detected, "
    "coalesce(any_value(min_lat), 0) AS min_lat, coalesce(any_value(max_lat), 0) AS max_lat, "
    "coalesce(any_value(min_lon), 0) AS min_lon, coalesce(any_value(max_lon), 0) AS max_lon, "
    "(coalesce(any_value(min_lat), 0) + coalesce(any_value(max_lat), 0)) / 2 AS center_lat, "
    "(coalesce(any_value(min_lon), 0) + coalesce(any_value(max_lon), 0)) / 2 AS center_lng, "
    f"round({SHARE}, 1) AS anomaly_rate FROM sc LEFT JOIN meta USING (aoi) GROUP BY aoi"
)


@query(
    "aoi_summary",
    compose([SC, META], AREAS, "aoi, total_patches, anomalies_detected",
            "min_lat, max_lat, min_lon, max_lon, center_lat, center_lng, anomaly_rate"),
)
def aoi_summary(spark, sf):
    return rounded(rs.area_summary(scores(spark, sf), tb.score_metadata(spark, sf), 64))


@query(
    "map_extent",
    compose([SC, META, f"a AS ({AREAS})"],
            "SELECT min(min_lat) AS min_lat, max(max_lat) AS max_lat, min(min_lon) AS min_lon, "
            "max(max_lon) AS max_lon, (min(min_lat) + max(max_lat)) / 2 AS center_lat, "
            "(min(min_lon) + max(max_lon)) / 2 AS center_lon FROM a",
            "", "min_lat, max_lat, min_lon, max_lon, center_lat, center_lon"),
)
def map_extent(spark, sf):
    return rounded(rs.map_extent(rs.area_summary(scores(spark, sf), tb.score_metadata(spark, sf), 64)))


@query(
    "aoi_rollup",
    compose([SC], f"SELECT aoi, count(*) AS total_patches, {HITS} AS anomalies_detected, "
            "avg(gate_prediction) AS mean_confidence FROM sc GROUP BY ROLLUP (aoi)",
            "aoi, total_patches, anomalies_detected", "mean_confidence"),
)
def aoi_rollup(spark, sf):
    return rounded(rs.area_rollup(scores(spark, sf)))


@query(
    "score_histogram",
    compose(
        [SC, "b AS (SELECT min(gate_prediction) AS lo, max(gate_prediction) AS hi FROM sc)",
         "h AS (SELECT least(coalesce(floor((gate_prediction - lo) / nullif(hi - lo, 0) * 50), 0), 49) AS i "
         "FROM sc, b WHERE gate_prediction IS NOT NULL)"],
        "SELECT CAST(r.bin AS INT) AS bin, count(h.i) AS patches FROM range(50) r(bin) LEFT JOIN h ON h.i = r.bin "
        "GROUP BY r.bin",
        "bin, patches",
    ),
)
def score_histogram(spark, sf):
    return rs.score_histogram(scores(spark, sf), 50)


@query(
    "score_percentiles",
    compose([SC], "SELECT avg(gate_prediction) AS mean, stddev_pop(gate_prediction) AS std, "
            "quantile_cont(gate_prediction, 0.95) AS p95, quantile_cont(gate_prediction, 0.99) AS p99 FROM sc",
            "", "mean, std, p95, p99"),
)
def score_percentiles(spark, sf):
    return rounded(ev.score_percentiles(scores(spark, sf), "gate_prediction"))


@query(
    "threshold_sweep",
    compose(
        [SC], "SELECT CAST(t AS DOUBLE) AS threshold, count(*) FILTER (WHERE gate_prediction >= t) AS detected, "
        "avg(CASE WHEN gate_prediction >= t THEN 1.0 ELSE 0.0 END) * 100 AS detected_pct "
        "FROM sc, (VALUES (0.3), (0.5), (0.7), (0.9)) v(t) GROUP BY t",
        "threshold, detected", "detected_pct",
    ),
)
def threshold_sweep(spark, sf):
    return rounded(rs.threshold_sweep(scores(spark, sf), (0.3, 0.5, 0.7, 0.9)))


# ---- evaluation and quality ------------------------------------------------


@query(
    "eval_regression",
    compose([SC], "SELECT avg(pow(gate_prediction - y, 2)) AS mse, avg(abs(gate_prediction - y)) AS mae, "
            "sqrt(avg(pow(gate_prediction - y, 2))) AS rmse, corr(y, gate_prediction) AS correlation FROM sc",
            "", "mse, mae, rmse, correlation"),
)
def eval_regression(spark, sf):
    return rounded(ev.regression_metrics(tb.patch_scores(spark, sf), "y", "gate_prediction"))


@query(
    "eval_confusion",
    compose([SC], "SELECT a AS actual, p AS predicted, count(sc.y) AS patches FROM "
            "(VALUES (0,0),(0,1),(1,0),(1,1)) v(a, p) LEFT JOIN sc ON y = a AND "
            "(gate_prediction >= 0.5) = (p = 1) GROUP BY a, p", "actual, predicted, patches"),
)
def eval_confusion(spark, sf):
    return ev.confusion_matrix(tb.patch_scores(spark, sf), "y", "gate_prediction")


@query(
    "eval_classification",
    compose(
        [SC, "c AS (SELECT CAST(count(*) FILTER (WHERE y=1 AND gate_prediction>=0.5) AS DOUBLE) AS tp, "
         "count(*) FILTER (WHERE y=0 AND gate_prediction>=0.5) AS fp, count(*) FILTER (WHERE y=1 AND "
         "gate_prediction<0.5) AS fn, count(*) FILTER (WHERE y=0 AND gate_prediction<0.5) AS tn FROM sc)"],
        "SELECT (tp + tn) / nullif(tp + tn + fp + fn, 0) AS accuracy, tp / nullif(tp + fp, 0) AS precision, "
        "tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c",
        "", "accuracy, precision, recall, f1",
    ),
)
def eval_classification(spark, sf):
    return rounded(ev.classification_metrics(tb.patch_scores(spark, sf), "y", "gate_prediction"))


@query(
    "dq_rules",
    compose(
        [PX, SC, unpivot_sql("px", tb.BASE_CHANNELS),
         "s AS (SELECT channel, stddev_pop(value) AS std FROM lng GROUP BY channel)",
         f"m AS (SELECT count(*) AS t, {HITS} AS a FROM sc GROUP BY aoi)"],
        "SELECT 'std_positive' AS rule, count(*) AS checked, count(*) FILTER (WHERE std <= 0) AS violations FROM s "
        "UNION ALL SELECT 'scores_in_unit_range', count(*), count(*) FILTER (WHERE z < 0 OR z > 1) FROM "
        "(SELECT (gate_prediction - 0.5) * 2.5 + 0.5 AS z FROM sc) "
        "UNION ALL SELECT 'anomalies_within_total', count(*), count(*) FILTER (WHERE a > t) FROM m "
        "UNION ALL SELECT 'identity_and_position', count(*), count(*) FILTER (WHERE row < 32) FROM sc",
        "rule, checked, violations",
    ),
)
def dq_rules(spark, sf):
    """Scores are stretched and rows shifted so that two rules find violations."""
    s = scores(spark, sf).withColumns(
        {"gate_prediction": (F.col("gate_prediction") - 0.5) * 2.5 + 0.5, "row": F.col("row") - 32}
    )
    stats = ev.channel_quick_stats(tb.pixels(spark, sf), tb.BASE_CHANNELS)
    summary = rs.prediction_summary(scores(spark, sf), 0.5, ["aoi"])
    return quality.rule_violations(s, stats, summary)


# ---- reports ---------------------------------------------------------------


@query(
    "geojson_features",
    compose(
        [SC, GRIDS],
        "SELECT patch_id, coalesce(x0 + (col + 32.5) * dx, col + 32) AS lon, coalesce(y0 + (row + 32.5) * dy, "
        "row + 32) AS lat, round(gate_prediction, 4) AS confidence, gate_prediction > 0.5 AS is_anomaly, row, "
        "col, round(prob_autoencoder, 4) AS prob_autoencoder, round(prob_iforest, 4) AS prob_iforest, "
        "round(prob_kmeans, 4) AS prob_kmeans, round(arch_similarity, 4) AS arch_similarity "
        "FROM sc LEFT JOIN grids USING (aoi) WHERE gate_prediction >= 0.5",
        "patch_id, is_anomaly, row, col",
        "lon, lat, confidence, prob_autoencoder, prob_iforest, prob_kmeans, arch_similarity",
    ),
)
def geojson_features(spark, sf):
    return rounded(rs.geojson_features(scores(spark, sf), 64, 0.5, _grids(spark, sf)))


@query(
    "csv_report",
    compose(
        [SC],
        'SELECT patch_id AS "Patch ID", row AS "Row", col AS "Col", round(gate_prediction, 4) AS '
        '"GATE Confidence", gate_prediction > 0.5 AS "Is Anomaly", round(prob_autoencoder, 4) AS '
        '"Autoencoder Score", round(prob_iforest, 4) AS "IForest Score", round(prob_kmeans, 4) AS '
        '"KMeans Score", round(arch_similarity, 4) AS "Arch Similarity" FROM sc',
        '"Patch ID", "Row", "Col", "Is Anomaly", "GATE Confidence", "Autoencoder Score", '
        '"IForest Score", "KMeans Score", "Arch Similarity"',
    ),
)
def csv_report(spark, sf):
    return rs.csv_report(scores(spark, sf))


@query(
    "json_report",
    compose(
        [SC],
        "SELECT patch_id, row, col, round(gate_prediction, 4) AS gate_confidence, gate_prediction > 0.5 AS "
        "is_anomaly, round(prob_autoencoder, 4) AS autoencoder, round(prob_iforest, 4) AS iforest, "
        "round(prob_kmeans, 4) AS kmeans, round(arch_similarity, 4) AS arch_similarity FROM sc",
        "patch_id, row, col, is_anomaly", "gate_confidence, autoencoder, iforest, kmeans, arch_similarity",
    ),
)
def json_report(spark, sf):
    return rs.json_report(scores(spark, sf)).select(
        "patch_id", "position.*", "gate_confidence", "is_anomaly", "model_breakdown.*"
    )


@query(
    "runs_latest",
    compose(
        ["l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)"],
        "SELECT user_id AS id, event_id AS seq, 'run ' || user_id AS title, event_type AS status, "
        "CAST(json_extract_string(props, '$.k') AS INT) < 10 AS is_demo, props AS results FROM l WHERE rn = 1",
        "id, seq, title, status, is_demo, results",
    ),
)
def runs_latest(spark, sf):
    return rs.newest_runs(tb.run_log(spark, sf)).drop("created_at")


@query(
    "run_lookup",
    compose(
        ["l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)",
         "c AS (SELECT user_id AS id, event_id AS seq, event_type AS status, ts, "
         "CAST(json_extract_string(props, '$.k') AS INT) < 10 AS is_demo FROM l WHERE rn = 1)"],
        "SELECT 'by_id' AS kind, id, seq, status FROM c WHERE id = 8 UNION ALL "
        "SELECT 'demo', id, seq, status FROM (SELECT * FROM c WHERE is_demo ORDER BY ts, seq LIMIT 1)",
        "kind, id, seq, status",
    ),
)
def run_lookup(spark, sf):
    """One run by its id, and the oldest demo run."""
    log = tb.run_log(spark, sf)
    pick = lambda df, kind: df.select(F.lit(kind).alias("kind"), "id", "seq", "status")
    return pick(rs.run_by_id(log, 8), "by_id").unionByName(pick(rs.first_demo_run(log), "demo"))


# ---- change and context ----------------------------------------------------


@query(
    "temporal_change",
    compose(
        [SC,
         "a AS (SELECT patch_id, gate_prediction AS score_before FROM sc WHERE label <> 4)",
         "b AS (SELECT patch_id, 1 / (1 + exp(-4 * CAST(embedding[6] AS DOUBLE))) AS score_after FROM sc WHERE label <> 7)"],
        "SELECT patch_id, score_before, score_after, score_after - score_before AS delta, "
        "CASE WHEN score_before IS NULL THEN 'new' WHEN score_after IS NULL THEN 'gone' "
        "WHEN score_after - score_before >= 0.1 THEN 'increased' WHEN score_after - score_before <= -0.1 "
        "THEN 'decreased' ELSE 'stable' END AS status FROM a FULL OUTER JOIN b USING (patch_id)",
        "patch_id, status", "score_before, score_after, delta",
    ),
)
def temporal_change(spark, sf):
    s = tb.patch_scores(spark, sf)
    later = fx.sigmoid(F.col("embedding")[5].cast("double") * 4.0)
    return rounded(
        rs.temporal_change(s.where("label <> 4"), s.where("label <> 7").withColumn("gate_prediction", later))
    )


@query(
    "spatial_context",
    compose(
        [SC],
        "SELECT s.patch_id, any_value(s.gate_prediction) AS gate_prediction, count(*) AS neighbours, "
        "avg(o.gate_prediction) AS neighbour_mean FROM sc s JOIN sc o ON o.aoi = s.aoi AND "
        "abs(o.row - s.row) <= 32 AND abs(o.col - s.col) <= 32 AND o.patch_id <> s.patch_id GROUP BY s.patch_id",
        "patch_id, neighbours", "gate_prediction, neighbour_mean",
    ),
)
def spatial_context(spark, sf):
    out = rs.spatial_context(scores(spark, sf), 32)
    return rounded(out.select("patch_id", "neighbours", "gate_prediction", "neighbour_mean"))


# ---- stacked classifier with fixed weights ---------------------------------


def _gate_sql() -> str:
    return compose(
        [SC, *gate_ctes(demo_weights(), "sc", "patch_id")],
        "SELECT patch_id, gate AS gate_prediction, CASE WHEN gate > 0.5 THEN 1.0 ELSE 0.0 END "
        "AS gate_binary FROM gated",
        "patch_id", "gate_prediction, gate_binary",
    )


@query("gate_mlp_score", _gate_sql())
def gate_mlp_score(spark, sf):
    model = demo_weights()
    s = scores(spark, sf).drop("gate_prediction")
    s = gate_score(s, model)
    s = gate_score(s, model, into="gate_binary", binary=True)
    return rounded(s.select("patch_id", "gate_prediction", "gate_binary"))


# ---- splits ----------------------------------------------------------------


@query(
    "split_by_aoi",
    compose(
        [SC, "a AS (SELECT aoi, row_number() OVER (ORDER BY md5('42|' || aoi)) AS rn, count(*) OVER () AS n "
         "FROM (SELECT DISTINCT aoi FROM sc))"],
        "SELECT aoi, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side FROM a", "aoi, side",
    ),
)
def split_by_aoi(spark, sf):
    return splits.split_areas(scores(spark, sf)).select("aoi", "side")


@query(
    "split_by_patch",
    compose(
        [SC, "a AS (SELECT patch_id, row_number() OVER (ORDER BY md5('42|' || patch_id)) AS rn, "
         "count(*) OVER () AS n FROM sc)"],
        "SELECT patch_id, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side FROM a",
        "patch_id, side",
    ),
)
def split_by_patch(spark, sf):
    return splits.split_patches(scores(spark, sf)).select("patch_id", "side")


@query(
    "split_stratified",
    compose(
        [SC, "a AS (SELECT patch_id, y, row_number() OVER (PARTITION BY y ORDER BY md5('42|' || patch_id)) AS rn, "
         "count(*) OVER (PARTITION BY y) AS n FROM sc)"],
        "SELECT patch_id, y, CASE WHEN rn <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS side FROM a",
        "patch_id, y, side",
    ),
)
def split_stratified(spark, sf):
    return splits.split_stratified(tb.patch_scores(spark, sf), "y").select("patch_id", "y", "side")
