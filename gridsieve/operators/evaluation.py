"""Score distributions and evaluation against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from .channels import unpivot_channels


def regression_metrics(rows: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(p) - F.col(y)
    mse = F.avg(e * e)
    return rows.agg(
        mse.alias("mse"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(mse).alias("rmse"),
        F.corr(y, p).alias("correlation"),
    )


def confusion_matrix(rows: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    """Counts of all four (actual, predicted) cells, zeros included."""
    counts = _cells(rows, y, p, threshold)
    cells = F.array(
        *[
            F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"), F.col(n).alias("patches"))
            for a, b, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))
        ]
    )
    return counts.select(F.explode(cells).alias("c")).select("c.*")


def _cells(rows, y, p, threshold):
    actual, hit = F.col(y) == 1, F.col(p) >= threshold
    return rows.agg(
        F.count_if(~actual & ~hit).alias("tn"),
        F.count_if(~actual & hit).alias("fp"),
        F.count_if(actual & ~hit).alias("fn"),
        F.count_if(actual & hit).alias("tp"),
    )


def classification_metrics(rows: DataFrame, y: str, p: str, threshold: float = 0.5) -> DataFrame:
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0))
    return _cells(rows, y, p, threshold).select(
        ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )


def similarity_stats(rows: DataFrame, value: str) -> DataFrame:
    """Mean, population deviation, range and exact median of a score."""
    median = exact_quantiles(rows, [], value, {"median": 0.5}).select("median").scalar()
    return rows.agg(
        F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        F.max(value).alias("max"),
        F.min(value).alias("min"),
    ).withColumn("median", median)


def score_percentiles(rows: DataFrame, value: str) -> DataFrame:
    q = exact_quantiles(rows, [], value, {"p95": 0.95, "p99": 0.99})
    at = q.select(F.struct("p95", "p99").alias("q")).scalar()
    return rows.agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).withColumns(
        {"p95": at["p95"], "p99": at["p99"]}
    )


def elevation_stats(patch_cells: DataFrame, keys: list[str], value: str = "dtm") -> DataFrame:
    """Elevation range and spread per patch."""
    return patch_cells.groupBy(*keys).agg(
        F.min(value).alias("min_elevation"),
        F.max(value).alias("max_elevation"),
        (F.max(value) - F.min(value)).alias("relief"),
        F.avg(value).alias("mean_elevation"),
        F.stddev_pop(value).alias("std_elevation"),
    )


def channel_quick_stats(cells: DataFrame, channels) -> DataFrame:
    """Mean and population deviation per channel over patch pixels."""
    return (
        unpivot_channels(cells, channels)
        .groupBy("channel")
        .agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))
    )


def area_bounds(scores: DataFrame, value: str) -> DataFrame:
    """Minimum and maximum of a score per area, for batch-wise scaling."""
    return scores.groupBy("aoi").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
