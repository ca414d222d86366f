"""Writers for patch and score stores, reports and the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS, MATRIX_COLUMNS, UNIFIED_COLUMNS
from ..operators.results import (
    csv_report,
    formatted_overview,
    geojson_features,
    geojson_lines,
    json_report,
    status_summary,
)
from ..session import sized_row_groups

# Lines and columns of patches that share one output task; spreads a dominant area.
BAND_ROWS = 4096
MAX_RECORDS_PER_FILE = 100_000


def _by_area(rows: DataFrame, path: str, mode: str) -> None:
    bands = [F.floor(F.col(c) / F.lit(float(BAND_ROWS))) for c in ("row", "col")]
    (
        sized_row_groups(rows.repartition("aoi", *bands))
        .mode(mode)
        .option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
        .partitionBy("aoi")
        .parquet(path)
    )


def write_patches(patches: DataFrame, path: str, channels=CHANNELS, mode="errorifexists") -> None:
    """Patch store, single precision, partitioned by area."""
    _by_area(
        patches.withColumns({c: F.col(c).cast("array<float>") for c in channels}), path, mode
    )


def write_unified_scores(scores: DataFrame, path: str, mode="errorifexists") -> None:
    """Five-score store; patch-constant scores stay one row per patch."""
    keep = ["aoi", "patch_id", "row", "col"]
    _by_area(
        scores.select(*keep, *[F.col(c).cast("float").alias(c) for c in UNIFIED_COLUMNS]), path, mode
    )


def write_score_matrix(scores: DataFrame, path: str, mode="errorifexists") -> None:
    """Four-column store."""
    keep = ["aoi", "patch_id", "row", "col"]
    _by_area(
        scores.select(*keep, *[F.col(c).cast("float").alias(c) for c in MATRIX_COLUMNS]), path, mode
    )


def write_band_files(bands: DataFrame, path: str, mode="errorifexists") -> None:
    """Long bands ``(aoi, band, row, col, value)``, a folder per area and band.

    Blocks of lines of a dominant area go to different tasks, each with a file of its own.
    """
    lines = F.floor(F.col("row") / F.lit(float(BAND_ROWS)))
    rows = bands.repartition("aoi", "band", lines)
    rows.write.mode(mode).partitionBy("aoi", "band").parquet(path)


def write_stats(stats: DataFrame, path: str, mode="errorifexists") -> None:
    """Seven rows of channel statistics as JSON."""
    stats.write.mode(mode).json(path)


def write_run_summary(summary: DataFrame, config, path: str, mode="errorifexists") -> None:
    """Counts and success rate next to the settings of the run."""
    settings = F.struct(
        F.lit(config.patch_size).alias("patch_size"),
        F.lit(config.stride).alias("stride"),
        F.lit(config.target_patches).alias("target_patches"),
        F.lit(config.min_valid_ratio).alias("min_valid_ratio"),
    )
    summary.withColumn("config", settings).write.mode(mode).json(path)


def write_run_record(status: DataFrame, config, path: str, mode="errorifexists") -> None:
    """Areas of a run with their state and reason, then its summary and settings.

    ``status`` comes from ``area_status``.  The lists are rows, one per area, split by state, as
    a run may have more areas than one row should hold.  The summary is derived from the rows
    as written and comes last: a record without one is incomplete.
    """
    status.write.mode(mode).partitionBy("ok").json(f"{path}/areas")
    kept = status.sparkSession.read.schema(status.schema).json(f"{path}/areas")
    write_run_summary(status_summary(kept), config, f"{path}/summary", mode)


def write_geojson(scores: DataFrame, path: str, patch: int, threshold=0.5, grids=None) -> None:
    """GeoJSON, one feature per line."""
    geojson_lines(geojson_features(scores, patch, threshold, grids)).write.text(path)


def write_csv_report(scores: DataFrame, path: str) -> None:
    csv_report(scores).write.option("header", "true").csv(path)


def write_json_report(scores: DataFrame, path: str) -> None:
    json_report(scores).write.json(path)


def write_report(scores: DataFrame, root: str, threshold: float = 0.5) -> None:
    """The whole JSON report: predictions, then their summary, then the patches of each area.

    The metadata comes last, so a report that has it is complete.
    """
    write_json_report(scores, f"{root}/predictions")
    formatted_overview(scores, threshold).write.json(f"{root}/summary")
    areas = scores.groupBy("aoi").agg(F.count(F.lit(1)).alias("total_patches"))
    areas.write.json(f"{root}/metadata")


def write_document(parts: dict[str, DataFrame], root: str) -> None:
    """Each part of the multi-area document as JSON lines below ``root``."""
    for name, rows in parts.items():
        rows.write.json(f"{root}/{name}")


def append_run(run: DataFrame, path: str) -> None:
    """A new state of a run; earlier states are never rewritten."""
    run.write.mode("append").parquet(path)


def response_bundle(scores: DataFrame, patch: int, threshold: float = 0.5) -> dict[str, DataFrame]:
    """Everything a client is sent after scoring, without images."""
    from ..operators.results import formatted_statistics

    return {
        "geojson": geojson_lines(geojson_features(scores, patch, threshold)),
        "overview": formatted_overview(scores, threshold),
        "top_candidates": formatted_statistics(scores),
        "csv": csv_report(scores),
        "json": json_report(scores),
    }
