"""Scalar score, label and position expressions (all plain Columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Epsilon terms, verdict texts and tier bounds.
MINMAX_EPS = 1e-10
VERDICT_HIGH = "HIGH ANOMALY LIKELIHOOD - Investigate!"
VERDICT_MODERATE = "MODERATE ANOMALY - Worth checking"
VERDICT_NORMAL = "LIKELY NORMAL TERRAIN"
MAP_TIERS = ((0.95, "critical"), (0.9, "high"), (0.8, "elevated"))
DETAIL_TIERS = ((0.9, "red"), (0.7, "orange"), (0.5, "yellow"))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def reconstruction_score(mse: Column) -> Column:
    """Online reconstruction score: logistic of ten times the error (never below 0.5)."""
    return sigmoid(mse * 10.0)


def sigmoid_uncertainty(recon: Column) -> Column:
    """1 at a reconstruction of 0.5, falling to 0 at 0 and 1."""
    return F.lit(1.0) - F.abs(recon - 0.5) * 2.0


def squared_error(x: Column, recon: Column) -> Column:
    return (x - recon) * (x - recon)


def minmax_eps(x: Column, low: Column, high: Column) -> Column:
    return (x - low) / (high - low + F.lit(MINMAX_EPS))


def minmax_guarded(x: Column, low: Column, high: Column) -> Column:
    """Min-max scaling that maps a flat range to 0."""
    spread = high - low
    flat = spread < MINMAX_EPS
    return F.when(flat, 0.0).otherwise((x - low) / F.when(flat, 1.0).otherwise(spread))


def shift_cosine(s: Column) -> Column:
    """Map [-1, 1] to [0, 1]."""
    return (s + 1.0) / 2.0


def standardize(x: Column, mean: Column, scale: Column) -> Column:
    return (x - mean) / scale


def is_anomaly(p: Column) -> Column:
    """The strict 0.5 flag, independent of any reporting threshold."""
    return p > 0.5


def binarize(p: Column) -> Column:
    return (p > 0.5).cast("int")


def verdict(score: Column) -> Column:
    return (
        F.when(score > 0.7, VERDICT_HIGH)
        .when(score > 0.5, VERDICT_MODERATE)
        .otherwise(VERDICT_NORMAL)
    )


def tier(score: Column, bounds, rest: str) -> Column:
    """Label of the first bound reached, bounds given from high to low."""
    out = None
    for bound, label in bounds:
        out = F.when(score >= bound, label) if out is None else out.when(score >= bound, label)
    return out.otherwise(rest)


def map_tier(score: Column) -> Column:
    return tier(score, MAP_TIERS, "low")


def detail_tier(score: Column) -> Column:
    return tier(score, DETAIL_TIERS, "green")


def border_tier(score: Column) -> Column:
    return F.when(score > 0.7, "red").when(score > 0.5, "orange").otherwise("yellow")


def clip(x: Column, low: Column, high: Column) -> Column:
    """Clamp, keeping NULL (greatest and least skip NULLs)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, high), low))


def r4(x: Column) -> Column:
    return F.round(x, 4)


def r6(x: Column) -> Column:
    return F.round(x, 6)


# ---- positions -------------------------------------------------------------


def patch_id(aoi: Column, ordinal: Column) -> Column:
    return F.format_string("%s_p%03d", aoi, ordinal.cast("int"))


def aoi_name(index: Column) -> Column:
    return F.format_string("AOI_%04d", index.cast("int"))


def aoi_index(name: Column) -> Column:
    return F.regexp_extract(name, r"AOI_(\d+)", 1).cast("int")


def patch_bounds(row: Column, col: Column, patch: int) -> Column:
    return F.struct(
        row.alias("row_start"),
        (row + patch).alias("row_end"),
        col.alias("col_start"),
        (col + patch).alias("col_end"),
    )


def interpolate_lat(row: Column, height: Column, min_lat: Column, max_lat: Column) -> Column:
    """Latitude of a pixel row inside the area bounds (row 0 is the northern edge)."""
    return max_lat - row / F.nullif(height, F.lit(0)) * (max_lat - min_lat)


def interpolate_lon(col: Column, width: Column, min_lon: Column, max_lon: Column) -> Column:
    return min_lon + col / F.nullif(width, F.lit(0)) * (max_lon - min_lon)


def affine_lat(row: Column, y0: Column, dy: Column) -> Column:
    """Pixel-centre latitude; the row itself when the area has no transform."""
    return F.coalesce(y0 + (row + 0.5) * dy, row.cast("double"))


def affine_lon(col: Column, x0: Column, dx: Column) -> Column:
    return F.coalesce(x0 + (col + 0.5) * dx, col.cast("double"))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of two array columns, 0 when either has zero length."""
    norm = vector_norm(a) * vector_norm(b)
    return F.when(norm == 0, 0.0).otherwise(vector_dot(a, b) / F.nullif(norm, F.lit(0.0)))


def vector_dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda s, x: s + x,
    )


def vector_norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    )


def array_mean(a: Column) -> Column:
    """Mean over the non-NULL elements of an array."""
    present = F.filter(a, lambda x: x.isNotNull())
    total = F.aggregate(present, F.lit(0.0), lambda s, x: s + x.cast("double"))
    return total / F.nullif(F.size(present), F.lit(0))


def sanitize_array(a: Column) -> Column:
    """NULL, NaN and infinities become 0, as a model input needs."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.transform(a, lambda x: F.when(bad(x), 0.0).otherwise(x.cast("double")))
