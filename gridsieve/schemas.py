"""Schemas of the tables that cross module and storage boundaries."""

from __future__ import annotations

from pyspark.sql import types as T

from .config import CHANNELS

AOI_META = T.StructType(
    [
        T.StructField("aoi_id", T.StringType()),
        T.StructField("index", T.IntegerType()),
        T.StructField("bounds", T.ArrayType(T.DoubleType())),
        T.StructField("lidar_filename", T.StringType()),
        T.StructField("max_lat", T.DoubleType()),
        T.StructField("min_lat", T.DoubleType()),
        T.StructField("max_lon", T.DoubleType()),
        T.StructField("min_lon", T.DoubleType()),
    ]
)

AOI_POLYGON = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField(
            "features",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "properties",
                            T.StructType(
                                [
                                    T.StructField("aoi_id", T.StringType()),
                                    T.StructField("lidar_file", T.StringType()),
                                ]
                            ),
                        ),
                        T.StructField(
                            "geometry",
                            T.StructType(
                                [
                                    T.StructField("type", T.StringType()),
                                    T.StructField(
                                        "coordinates",
                                        T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType()))),
                                    ),
                                ]
                            ),
                        ),
                    ]
                )
            ),
        ),
    ]
)

PATCH_SCORE = T.StructType(
    [
        T.StructField("aoi", T.StringType()),
        T.StructField("patch_id", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("prob_autoencoder", T.DoubleType()),
        T.StructField("prob_iforest", T.DoubleType()),
        T.StructField("prob_kmeans", T.DoubleType()),
        T.StructField("arch_similarity", T.DoubleType()),
        T.StructField("gate_prediction", T.DoubleType()),
    ]
)


def patch_schema(channels=CHANNELS) -> T.StructType:
    """One row per patch: position, NDVI count, one row-major array per channel."""
    fields = [
        T.StructField("aoi", T.StringType()),
        T.StructField("row", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("n_valid", T.LongType()),
    ]
    fields += [T.StructField(c, T.ArrayType(T.DoubleType())) for c in channels]
    return T.StructType(fields)
