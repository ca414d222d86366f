"""Queries that write with a sink, read back with a source, or run as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import PreprocessingConfig
from ..operators import channels as ch
from ..operators import patches as pt
from ..operators import results as rs
from ..operators import similarity as sim
from ..operators.models import clusters
from ..operators.models.gate import demo_weights
from ..session import scratch_path
from ..sources import models, readers, sinks
from ..streaming import scoring as st
from . import tables as tb
from .pixel_queries import _usable_areas
from .registry import META, PX, SC, SQL, compose, cut_sql, query, rounded
from .score_queries import _anomalies

FLOATS = "prob_autoencoder, prob_iforest, prob_kmeans, arch_similarity, gate_prediction"


@query(
    "coords_parse",
    compose(
        [SC, META],
        "SELECT aoi, 'tile_' || CAST(CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) AS VARCHAR) || '.tif' "
        "AS lidar_file, min_lon, min_lat, max_lon, max_lat FROM meta",
        "aoi, lidar_file", "min_lon, min_lat, max_lon, max_lat",
    ),
)
def coords_parse(spark, sf):
    """One ``key: value`` text per area, written by Spark and parsed back."""
    meta = tb.score_metadata(spark, sf)
    path = scratch_path(spark, "coordinates")
    line = lambda key, c: F.concat(F.lit(f"{key}: "), c)
    number = lambda c: F.format_string("%.6f", F.col(c))
    lines = F.array(
        line("AOI_ID", F.col("aoi_id")),
        line("LiDAR_File", F.col("lidar_filename")),
        *[line(k, number(k)) for k in ("min_lon", "min_lat", "max_lon", "max_lat")],
    )
    # One directory per area keeps the lines of an area in files of their own.
    meta.select("aoi_id", F.array_join(lines, "\n").alias("value")).write.partitionBy(
        "aoi_id"
    ).text(path)
    read = readers.read_coordinates(spark, path)
    return rounded(readers.parse_coordinates(read.withColumn("file", F.regexp_extract("file", r"(AOI_\d+)", 1))))


@query(
    "polygon_bounds",
    compose([SC, META], "SELECT aoi, min_lon, min_lat, max_lon, max_lat, 5 AS ring_points FROM meta",
            "aoi, ring_points", "min_lon, min_lat, max_lon, max_lat"),
)
def polygon_bounds(spark, sf):
    """Area polygons written as GeoJSON documents and measured again."""
    meta = tb.score_metadata(spark, sf)
    at = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(
        at("max_lon", "min_lat"), at("max_lon", "max_lat"), at("min_lon", "max_lat"),
        at("min_lon", "min_lat"), at("max_lon", "min_lat"),
    )
    feature = F.struct(
        F.struct("aoi_id", F.col("lidar_filename").alias("lidar_file")).alias("properties"),
        F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"),
    )
    path = scratch_path(spark, "polygons")
    doc = F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features")))
    meta.select("aoi_id", doc.alias("value")).write.partitionBy("aoi_id").text(path)
    return rounded(readers.read_polygons(spark, path).select("aoi", "min_lon", "min_lat", "max_lon", "max_lat", "ring_points"))


@query(
    "aoi_metadata_json",
    compose([SC, META], "SELECT aoi, min_lat, max_lat, min_lon, max_lon FROM meta",
            "aoi", "min_lat, max_lat, min_lon, max_lon"),
)
def aoi_metadata_json(spark, sf):
    """Metadata documents, one per area."""
    path = scratch_path(spark, "metadata")
    meta = tb.score_metadata(spark, sf)
    meta.select(F.col("aoi_id").alias("part"), F.to_json(F.struct(*meta.columns)).alias("value")).write.partitionBy("part").text(path)
    back = readers.read_aoi_metadata(spark, path)
    return rounded(back.select(F.col("aoi_id").alias("aoi"), "min_lat", "max_lat", "min_lon", "max_lon"))


@query(
    "patch_store_roundtrip",
    compose(
        [PX, cut_sql("px")],
        "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, count(ndvi) AS n_valid, "
        "round(avg(CAST(coalesce(ndvi, 0) AS FLOAT)), 4) AS ndvi_mean FROM pp GROUP BY aoi, r0, c0",
        "aoi, row, col, n_valid", "ndvi_mean",
    ),
)
def patch_store_roundtrip(spark, sf):
    """Patches written in single precision per area, and all of them read back."""
    pair = ("ndvi", "dtm")
    px = tb.pixels(spark, sf).select("aoi", "row", "col", *pair)
    path = scratch_path(spark, "patches")
    sinks.write_patches(pt.extract_patches(px, tb.PIXEL_GRID, tb.MIN_VALID, pair), path, pair)
    back = readers.read_patches(spark, path, pair)
    pooled = pt.pool_arrays(back, ("ndvi",))
    return pooled.select(
        "aoi", "row", "col", "n_valid", F.round("ndvi_mean", 4).alias("ndvi_mean")
    )


def _f32(names: str) -> str:
    return ", ".join(f"round(CAST(CAST({c} AS FLOAT) AS DOUBLE), 4) AS {c}" for c in names.split(", "))


@query(
    "unified_store_roundtrip",
    compose([SC], f"SELECT aoi, patch_id, row, col, {_f32(FLOATS)} FROM sc", "aoi, patch_id, row, col", FLOATS),
)
def unified_store_roundtrip(spark, sf):
    path = scratch_path(spark, "unified")
    sinks.write_unified_scores(tb.scores_only(spark, sf), path)
    back = readers.read_by_area(spark, path)
    return back.select(
        "aoi", "patch_id", "row", "col",
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in FLOATS.split(", ")],
    )


FOUR = "prob_autoencoder, prob_iforest, prob_template, sim_score"


@query(
    "matrix_store_roundtrip",
    compose(
        [SC, "m AS (SELECT aoi, patch_id, row, col, prob_autoencoder, prob_iforest, prob_kmeans AS prob_template, "
         "arch_similarity AS sim_score FROM sc)"],
        f"SELECT aoi, patch_id, row, col, {_f32(FOUR)} FROM m",
        "aoi, patch_id, row, col", FOUR,
    ),
)
def matrix_store_roundtrip(spark, sf):
    path = scratch_path(spark, "matrix")
    rows = tb.scores_only(spark, sf).withColumnsRenamed(
        {"prob_kmeans": "prob_template", "arch_similarity": "sim_score"}
    )
    sinks.write_score_matrix(rows, path)
    back = readers.read_by_area(spark, path)
    return back.select(
        "aoi", "patch_id", "row", "col",
        *[F.round(F.col(c).cast("double"), 4).alias(c) for c in FOUR.split(", ")],
    )


@query("stats_json_roundtrip", SQL["global_stats"])
def stats_json_roundtrip(spark, sf):
    path = scratch_path(spark, "stats-json")
    sinks.write_stats(ch.global_stats(tb.pixels(spark, sf), tb.BASE_CHANNELS), path)
    back = spark.read.schema(
        "channel string, mean double, std double, p_low double, p_high double"
    ).json(path)
    return rounded(back)


@query("csv_report_roundtrip", SQL["csv_report"])
def csv_report_roundtrip(spark, sf):
    path = scratch_path(spark, "csv-report")
    sinks.write_csv_report(tb.scores_only(spark, sf), path)
    schema = rs.csv_report(tb.scores_only(spark, sf)).schema
    return spark.read.schema(schema).option("header", "true").csv(path)


@query("json_report_roundtrip", SQL["json_report"])
def json_report_roundtrip(spark, sf):
    path = scratch_path(spark, "json-report")
    sinks.write_json_report(tb.scores_only(spark, sf), path)
    back = spark.read.schema(rs.json_report(tb.scores_only(spark, sf)).schema).json(path)
    return back.select("patch_id", "position.*", "gate_confidence", "is_anomaly", "model_breakdown.*")


@query(
    "geojson_roundtrip",
    compose(
        [SC],
        "SELECT patch_id, col + 32.0 AS lon, row + 32.0 AS lat, round(gate_prediction, 4) AS confidence "
        "FROM sc WHERE gate_prediction >= 0.5", "patch_id", "lon, lat, confidence",
    ).replace("col + 32.0", "CAST(col + 32 AS DOUBLE)").replace("row + 32.0", "CAST(row + 32 AS DOUBLE)"),
)
def geojson_roundtrip(spark, sf):
    path = scratch_path(spark, "geojson")
    sinks.write_geojson(tb.scores_only(spark, sf), path, 64)
    shape = (
        "type string, geometry struct<type: string, coordinates: array<double>>, "
        "properties struct<patch_id: string, confidence: double>"
    )
    back = spark.read.schema(shape).json(path)
    return back.select(
        "properties.patch_id",
        F.col("geometry.coordinates")[0].alias("lon"),
        F.col("geometry.coordinates")[1].alias("lat"),
        "properties.confidence",
    )


@query("demo_document", SQL["extract_anomalies"])
def demo_document(spark, sf):
    """The multi-area document written in parts; all its anomalies read back."""
    from .score_queries import _flat_anomalies

    root = scratch_path(spark, "document")
    parts = rs.result_document(tb.scores_only(spark, sf), tb.score_metadata(spark, sf), 64)
    sinks.write_document(parts, root)
    schemas = {name: rows.schema for name, rows in parts.items()}
    return _flat_anomalies(readers.read_document(spark, root, schemas)["all_anomalies"])


@query("run_log_roundtrip", SQL["runs_latest"])
def run_log_roundtrip(spark, sf):
    """The log appended in two writes; the newest state of every run wins."""
    path = scratch_path(spark, "runs")
    log = tb.run_log(spark, sf)
    sinks.append_run(log.where("status <> 'purchase'"), path)
    sinks.append_run(log.where("status = 'purchase'"), path)
    return rs.newest_runs(spark.read.parquet(path)).drop("created_at")


@query("model_store_roundtrip", SQL["kmeans_cosine"])
def model_store_roundtrip(spark, sf):
    """Cluster centres stored with a scaler, loaded again and used for scoring."""
    path = scratch_path(spark, "model")
    stats = clusters.scaler_stats(tb.table(spark, sf, "embeddings"), "embedding")
    models.save_model(path, tb.centroids(spark, sf), scaler=stats)
    loaded = models.load_model(spark, path)
    out = sim.cluster_cosine(tb.patch_vectors(spark, sf), loaded["model"], "vec_id")
    return rounded(out)


@query("run_summary_roundtrip", SQL["processing_summary"])
def run_summary_roundtrip(spark, sf):
    """Counts and success rate of a run as JSON next to its settings."""
    path = scratch_path(spark, "run-summary")
    px = tb.pixels(spark, sf)
    sinks.write_run_summary(
        rs.processing_summary(px, _usable_areas(px)), PreprocessingConfig(), path
    )
    back = spark.read.schema("successful long, failed long, success_rate double").json(path)
    return rounded(back)


WHY = "too few valid elevations: "


@query(
    "run_record_roundtrip",
    compose(
        [PX, "a AS (SELECT aoi, count(dtm) AS n FROM px GROUP BY aoi)"],
        f"SELECT aoi, n >= 1990 AS ok, CASE WHEN n < 1990 THEN '{WHY}' || n END AS reason, "
        "count(*) FILTER (WHERE n >= 1990) OVER () AS successful, "
        "count(*) FILTER (WHERE n < 1990) OVER () AS failed, "
        "avg(CASE WHEN n >= 1990 THEN 100.0 ELSE 0.0 END) OVER () AS success_rate FROM a",
        "aoi, ok, reason, successful, failed", "success_rate",
    ),
)
def run_record_roundtrip(spark, sf):
    """Every area of a run with its state and reason, next to the run's summary."""
    path = scratch_path(spark, "run-record")
    px = tb.pixels(spark, sf)
    valid = px.groupBy("aoi").agg(F.count("dtm").alias("n"))
    reasons = valid.select("aoi", F.concat(F.lit(WHY), F.col("n").cast("string")).alias("reason"))
    sinks.write_run_record(
        rs.area_status(px, _usable_areas(px), reasons), PreprocessingConfig(), path
    )
    back = readers.read_run_record(spark, path)
    good = back["successful"].select("aoi", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("reason"))
    bad = back["failed"].select("aoi", F.lit(False).alias("ok"), "reason")
    return rounded(good.unionByName(bad).join(F.broadcast(back["summary"])))


@query(
    "json_report_blocks",
    compose(
        [SC, "m AS (SELECT aoi, count(*) AS area_patches FROM sc GROUP BY aoi)",
         f"o AS ({SQL['formatted_overview']})", f"p AS (SELECT count(*) AS predictions FROM ({SQL['json_report']}))"],
        "SELECT * FROM m, o, p", "*",
    ),
)
def json_report_blocks(spark, sf):
    """Metadata of every area, the summary, and the number of predictions, read back."""
    root = scratch_path(spark, "report")
    scores = tb.scores_only(spark, sf)
    sinks.write_report(scores, root)
    blocks = readers.read_report(spark, root, {
        "metadata": "aoi string, total_patches long",
        "summary": rs.formatted_overview(scores, 0.5).schema,
        "predictions": rs.json_report(scores).schema,
    })
    whole = blocks["predictions"].agg(F.count(F.lit(1)).alias("predictions"))
    areas = blocks["metadata"].withColumnRenamed("total_patches", "area_patches")
    return rounded(areas.join(F.broadcast(blocks["summary"])).join(F.broadcast(whole)))


@query(
    "response_bundle",
    compose(
        [SC],
        "SELECT (SELECT count(*) FROM sc WHERE gate_prediction >= 0.5) AS features, count(*) AS csv_rows, "
        "count(*) AS json_rows, least(count(*), 10) AS top_candidates, "
        "count(*) FILTER (WHERE gate_prediction >= 0.5) AS anomalies FROM sc",
        "features, csv_rows, json_rows, top_candidates, anomalies",
    ),
)
def response_bundle(spark, sf):
    """Row counts of every part sent to a client after scoring."""
    parts = sinks.response_bundle(tb.scores_only(spark, sf), 64)
    n = lambda name: parts[name].agg(F.count(F.lit(1))).scalar()
    return parts["overview"].select(
        n("geojson").alias("features"),
        n("csv").alias("csv_rows"),
        n("json").alias("json_rows"),
        n("top_candidates").alias("top_candidates"),
        F.col("anomalies_detected").alias("anomalies"),
    )


# ---- streams ---------------------------------------------------------------


def _arrivals(spark, sf, copies: int = 1):
    """Scores with an arrival time, written as several files."""
    path = scratch_path(spark, "arrivals")
    s = tb.patch_scores(spark, sf).select(
        "aoi", "patch_id", "row", "col", *FLOATS.split(", ")[:4],
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("vec_id")).alias("ts"),
    )
    if copies > 1:
        s = s.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))).drop("copy")
    s.repartition(4, "patch_id", "ts").write.parquet(path)
    return path, s.schema


@query("stream_scores", SQL["gate_mlp_score"])
def stream_scores(spark, sf):
    """Scoring as patches arrive, file by file; equals the batch result."""
    path, schema = _arrivals(spark, sf)
    out, mark = scratch_path(spark, "scored"), scratch_path(spark, "progress")
    scored = st.score_patches(st.read_stream(spark, path, schema, files_per_batch=1), demo_weights())
    st.run_available(scored, out, mark)
    back = spark.read.schema(scored.schema).parquet(out)
    return rounded(
        back.select("patch_id", "gate_prediction", F.col("is_anomaly").cast("double").alias("gate_binary"))
    )


@query("stream_dedup", compose([SC], "SELECT patch_id FROM sc", "patch_id"))
def stream_dedup(spark, sf):
    """Every patch is delivered three times, in any order of time, and kept once."""
    path, schema = _arrivals(spark, sf, copies=3)
    out, mark = scratch_path(spark, "deduped"), scratch_path(spark, "progress")
    once = st.first_arrivals(st.read_stream(spark, path, schema, files_per_batch=1)).select("patch_id")
    st.run_available(once, out, mark)
    return spark.read.schema("patch_id string").parquet(out)


@query("stream_incremental", SQL["gate_mlp_score"])
def stream_incremental(spark, sf):
    """Only patches that are not stored yet are scored: every patch comes twice, all come once
    more after a restart, and everything is read again after the checkpoint is lost."""
    path, schema = _arrivals(spark, sf, copies=2)
    store = scratch_path(spark, "incremental")
    score = lambda rows: st.score_patches(rows, demo_weights())
    arriving = lambda: st.read_stream(spark, path, schema, files_per_batch=2)
    mark = scratch_path(spark, "progress")
    st.run_incremental(arriving(), store, mark, score, order="ts")
    again, _ = _arrivals(spark, sf)
    spark.read.schema(schema).parquet(again).write.mode("append").parquet(path)
    st.run_incremental(arriving(), store, mark, score, order="ts")
    st.run_incremental(arriving(), store, scratch_path(spark, "progress"), score, order="ts")
    scored = score(spark.read.schema(schema).parquet(path)).schema
    return rounded(
        st.committed_rows(spark, store, scored).select(
            "patch_id", "gate_prediction", F.col("is_anomaly").cast("double").alias("gate_binary")
        )
    )


@query(
    "stream_window_counts",
    compose(
        ["w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL)"],
        "SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n FROM w",
        "window_start, event_type, n",
    ),
)
def stream_window_counts(spark, sf):
    """Hourly counts of all events."""
    ev = tb.table(spark, sf, "events").select("ts", "event_type")
    stream = st.read_stream(spark, sf, ev.schema, glob="events.parquet").withColumn(
        "ts", F.col("ts").cast("timestamp")
    )
    out, mark = scratch_path(spark, "windows"), scratch_path(spark, "progress")
    hourly = lambda rows: st.window_counts(rows, "ts", ["event_type"], "1 hour")
    st.run_partials(stream, out, mark, hourly)
    back = st.summed_rows(spark, out, hourly(stream).schema, ["window_start", "event_type"])
    return back.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n"
    )


@query(
    "site_dimensions",
    compose([SC], "SELECT aoi, patch_id FROM sc WHERE label = 0 AND vec_id % 7 = 0", "aoi, patch_id"),
)
def site_dimensions(spark, sf):
    """Sites whose stored vector has another length than the patches' vectors."""
    sites = tb.patch_scores(spark, sf).where("label = 0")
    short = F.slice("embedding", 1, 10)
    path = scratch_path(spark, "sites")
    mixed = F.when(F.col("vec_id") % 7 == 0, short).otherwise(F.col("embedding"))
    sites.select("aoi", "patch_id", mixed.alias("embedding")).write.parquet(path)
    expected = tb.patch_vectors(spark, sf).agg(F.max(F.size("embedding")).alias("dim"))
    return readers.dimension_mismatches(spark.read.parquet(path), expected)
