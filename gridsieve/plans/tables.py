"""Pixel, patch and score tables derived by Spark from the generic test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PatchGrid
from ..functions.scalars import aoi_name, patch_id, sigmoid
from ..operators import channels as ch

PIXEL_GRID = PatchGrid(16, 8)
SCORE_GRID = PatchGrid(64, 32)
MIN_VALID = 0.8
NODATA = -9999.0
BASE_CHANNELS = ("dtm", "ndvi", "ndwi", "flow_acc", "flow_dir")
ELEMENTS = {
    "prob_autoencoder": 0,
    "gate_prediction": 1,
    "prob_iforest": 2,
    "prob_kmeans": 3,
    "arch_similarity": 4,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unprocessed bands on a 50-wide grid, one row per event."""
    ev = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    at = F.col("event_id") % 2500
    code = F.col("event_id") % 9
    return ev.select(
        aoi_name(F.floor(F.col("event_id") / 2500.0)).alias("aoi"),
        F.floor(at / 50.0).cast("int").alias("row"),
        (F.col("event_id") % 50).cast("int").alias("col"),
        F.when(F.col("event_type") == "error", NODATA).otherwise(F.col("value")).alias("elevation"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("red"),
        (F.col("user_id").cast("double") + 1.0).alias("green"),
        (k * 4.0).alias("nir"),
        F.when(k == 99, float(ch.FLOW_ACC_NODATA)).otherwise(k).alias("acc"),
        F.when(code == 8, 255.0).otherwise(F.pow(F.lit(2.0), code.cast("double"))).alias("dir"),
    )


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base channels: masked elevation, indices, encoded flow."""
    raw = raw_pixels(spark, sf_dir)
    return raw.select(
        "aoi",
        "row",
        "col",
        ch.positive_only(ch.without_nodata(F.col("elevation"), NODATA)).alias("dtm"),
        ch.ndvi(F.col("nir"), F.col("red")).alias("ndvi"),
        ch.ndwi(F.col("green"), F.col("nir")).alias("ndwi"),
        ch.log_flow_acc(F.col("acc")).alias("flow_acc"),
        ch.flow_dir_sine(F.col("dir")).alias("flow_dir"),
    )


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form ``(aoi, band, row, col, value)``; AOI_0001 lacks the water index."""
    long = pixels(spark, sf_dir).unpivot(
        ["aoi", "row", "col"], list(BASE_CHANNELS), "band", "value"
    )
    return long.where(~((F.col("aoi") == "AOI_0001") & (F.col("band") == "ndwi")))


def patch_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten by ten patches per area with five scores and a label."""
    e = table(spark, sf_dir, "embeddings")
    area = F.floor(F.col("vec_id") / 100.0)
    at = F.col("vec_id") % 100
    score = lambda i: sigmoid(F.col("embedding")[i].cast("double") * 4.0)
    return e.select(
        "vec_id",
        aoi_name(area).alias("aoi"),
        patch_id(aoi_name(area), at).alias("patch_id"),
        (F.floor(at / 10.0) * 32).cast("int").alias("row"),
        (F.col("vec_id") % 10 * 32).cast("int").alias("col"),
        *[score(i).alias(name) for name, i in ELEMENTS.items()],
        F.when(F.col("label") < 2, 1).otherwise(0).alias("y"),
        "label",
        "embedding",
    )


def scores_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_scores(spark, sf_dir).drop("vec_id", "y", "label", "embedding")


def reference_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of label 0, numbered in id order."""
    from ..operators.similarity import number_sites

    sites = patch_scores(spark, sf_dir).where("label = 0")
    return number_sites(sites.select("vec_id", "aoi", "patch_id", "embedding"), "vec_id")


def patch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return patch_scores(spark, sf_dir).where("label <> 0")


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean vector per label, used as cluster centres; at most ten labels exist."""
    from ..operators.similarity import mean_vectors

    return mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding").withColumnRenamed(
        "label", "cluster"
    )


def area_metadata(areas: DataFrame) -> DataFrame:
    """Bounds of each area by its number; AOI_0002 has no metadata."""
    i = F.regexp_extract("aoi", r"AOI_(\d+)", 1).cast("int")
    return areas.where(F.col("aoi") != "AOI_0002").select(
        F.col("aoi").alias("aoi_id"),
        i.alias("index"),
        F.array(
            -55.0 + i * 0.01, -3.4 + i * 0.01, -54.99 + i * 0.01, -3.391 + i * 0.01
        ).alias("bounds"),
        F.format_string("tile_%d.laz", i).alias("lidar_filename"),
        (-3.391 + i * 0.01).alias("max_lat"),
        (-3.4 + i * 0.01).alias("min_lat"),
        (-54.99 + i * 0.01).alias("max_lon"),
        (-55.0 + i * 0.01).alias("min_lon"),
    )


def score_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return area_metadata(scores_only(spark, sf_dir).select("aoi").distinct())


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the status log of analysis runs."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"),
        F.col("event_id").alias("seq"),
        F.concat(F.lit("run "), F.col("user_id").cast("string")).alias("title"),
        F.col("event_type").alias("status"),
        (F.get_json_object("props", "$.k").cast("int") < 10).alias("is_demo"),
        F.col("props").alias("results"),
        F.col("ts").alias("created_at"),
    )


def scaled_pixels(
    spark: SparkSession, sf_dir: str, side: int = 512, copies: int = 20
) -> DataFrame:
    """Base channels of ``copies`` times as many pixels on ``side x side`` areas.

    Each copy of an event is a pixel of its own with a slightly changed value; the
    last, incomplete area is kept.  Serves to measure throughput at the default
    patch geometry.
    """
    base = pixels(spark, sf_dir).repartition("row")
    wide = base.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    old = (
        F.substring("aoi", 5, 8).cast("long") * 2500 + F.col("row") * 50 + F.col("col")
    )
    at = old * copies + F.col("copy")
    cell = at % (side * side)
    return wide.select(
        aoi_name(F.floor(at / float(side * side))).alias("aoi"),
        F.floor(cell / float(side)).cast("int").alias("row"),
        (cell % side).cast("int").alias("col"),
        (F.col("dtm") + F.col("copy") * 0.01).alias("dtm"),
        *BASE_CHANNELS[1:],
    )
