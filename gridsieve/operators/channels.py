"""Band masks, channel alignment, global statistics and normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions.quantiles import exact_quantiles
from ..functions.ranking import hash_limits, sample_per_group, seeded_hash
from ..functions.scalars import clip
from ..session import attach_small, settle

# Missing marker of flow accumulation, D8 codes and their angles,
# and the limits below which an elevation band counts as unusable.
FLOW_ACC_NODATA = 4294967295
D8_ANGLES = {1: 0, 2: 45, 4: 90, 8: 135, 16: 180, 32: 225, 64: 270, 128: 315}
MIN_DTM_PIXELS = 100
MIN_DTM_MAX = 0.1


# ---- single-band expressions ----------------------------------------------


def without_nodata(value: Column, nodata: Column | float | None) -> Column:
    """NaN and the band's nodata value become NULL."""
    clean = F.when(~F.isnan(value), value)
    return clean if nodata is None else F.nullif(clean, F.lit(nodata).cast("double"))


def positive_only(value: Column) -> Column:
    return F.when(value > 0, value)


def log_flow_acc(value: Column, nodata: float = FLOW_ACC_NODATA) -> Column:
    return F.when((value != nodata) & (value > 0), F.log1p(value))


def flow_dir_sine(code: Column) -> Column:
    """Sine of the D8 direction; any other code is missing."""
    out = None
    for d8, angle in D8_ANGLES.items():
        value = F.sin(F.radians(F.lit(float(angle))))
        out = F.when(code == d8, value) if out is None else out.when(code == d8, value)
    return out


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), NULL for a zero sum."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


def ndvi(nir: Column, red: Column) -> Column:
    return normalized_difference(nir, red)


def ndwi(green: Column, nir: Column) -> Column:
    return normalized_difference(green, nir)


# ---- grids and alignment ---------------------------------------------------


def reference_grid(pixels: DataFrame) -> DataFrame:
    """Height and width of every area, defined by its NDVI raster."""
    return pixels.groupBy("aoi").agg(
        (F.max("row") + 1).cast("int").alias("height"),
        (F.max("col") + 1).cast("int").alias("width"),
    )


def align_bands(
    bands: DataFrame, names: tuple[str, ...] = CHANNELS, reference: str = "ndvi"
) -> DataFrame:
    """Long bands ``(aoi, band, row, col, value)`` to one row per reference pixel.

    A band that an area lacks comes out as NULL.  One aggregation replaces a
    join per band, so the pixels are shuffled once.
    """
    columns = [F.max(F.when(F.col("band") == n, F.col("value"))).alias(n) for n in names]
    on_grid = F.max(F.when(F.col("band") == reference, F.lit(True))).alias("__grid")
    return (
        bands.where(F.col("band").isin(list(names)))
        .groupBy("aoi", "row", "col")
        .agg(on_grid, *columns)
        .where("__grid")
        .drop("__grid")
    )


def resample(
    source: DataFrame,
    target: DataFrame,
    value: str,
    method: str = "bilinear",
) -> DataFrame:
    """Sample ``source`` at target pixels, both on axis-aligned grids of one CRS.

    ``source`` is ``(aoi, row, col, value)``; ``target`` is ``(aoi, row, col, src_row,
    src_col)`` with fractional source positions.  Each source pixel is offered to
    the four cells it is a corner of, so targets are shuffled only once.
    """
    if method == "nearest":
        near = target.withColumn("__r", F.floor(F.col("src_row") + 0.5)).withColumn(
            "__c", F.floor(F.col("src_col") + 0.5)
        )
        src = source.select(
            "aoi",
            F.col("row").cast("long").alias("__r"),
            F.col("col").cast("long").alias("__c"),
            F.col(value).alias(value),
        )
        return near.join(src, ["aoi", "__r", "__c"], "left").select("aoi", "row", "col", value)
    if method != "bilinear":
        raise ValueError("method must be 'bilinear' or 'nearest'")
    corner = F.explode(
        F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a in (0, 1) for b in (0, 1)])
    )
    pick = lambda a, b, what: F.max(
        F.when((F.col("k.dr") == a) & (F.col("k.dc") == b), what)
    ).alias(f"v{a}{b}")
    cells = (
        source.where(F.col(value).isNotNull())
        .select("aoi", "row", "col", value, corner.alias("k"))
        .groupBy(
            "aoi",
            (F.col("row") - F.col("k.dr")).cast("long").alias("__r"),
            (F.col("col") - F.col("k.dc")).cast("long").alias("__c"),
        )
        .agg(*[pick(a, b, F.col(value)) for a in (0, 1) for b in (0, 1)])
    )
    placed = target.withColumn("__r", F.floor("src_row")).withColumn("__c", F.floor("src_col"))
    fr, fc = F.col("src_row") - F.col("__r"), F.col("src_col") - F.col("__c")
    share = {
        (0, 0): (1 - fr) * (1 - fc),
        (0, 1): (1 - fr) * fc,
        (1, 0): fr * (1 - fc),
        (1, 1): fr * fc,
    }
    total = weight = F.lit(0.0)
    for (a, b), s in share.items():
        v = F.col(f"v{a}{b}")
        total = total + F.when(v.isNotNull(), v * s).otherwise(0.0)
        weight = weight + F.when(v.isNotNull(), s).otherwise(0.0)
    return placed.join(cells, ["aoi", "__r", "__c"], "left").select(
        "aoi", "row", "col", (total / F.nullif(weight, F.lit(0.0))).alias(value)
    )


# ---- per-area statistics ---------------------------------------------------


def dtm_area_stats(pixels: DataFrame) -> DataFrame:
    """Median, valid count, maximum and any-valid flag of elevation per area."""
    counts = pixels.groupBy("aoi").agg(
        F.count("dtm").alias("valid"),
        F.max("dtm").alias("max_dtm"),
        (F.count("dtm") > 0).alias("dtm_valid"),
    )
    medians = exact_quantiles(pixels, ["aoi"], "dtm", {"median_dtm": 0.5}).drop("n")
    return counts.join(medians, "aoi", "left")


def drop_unusable_dtm(pixels: DataFrame) -> DataFrame:
    """Blank the elevation of areas with too few or only flat-zero pixels."""
    usable = pixels.groupBy("aoi").agg(
        ((F.count("dtm") >= MIN_DTM_PIXELS) & (F.max("dtm") >= MIN_DTM_MAX)).alias("__ok")
    )
    return (
        attach_small(pixels, usable, ["aoi"])
        .withColumn("dtm", F.when(F.col("__ok"), F.col("dtm")))
        .drop("__ok")
    )


def fill_with_median(
    pixels: DataFrame, value: str = "dtm", into: str = "filled", drop_unusable: bool = False
) -> DataFrame:
    """Missing pixels take the median of their area; keeps the valid count.

    ``drop_unusable`` blanks unusable elevation on the way, as
    ``drop_unusable_dtm`` does, without another pass: the largest value is the
    quantile at 1.
    """
    areas = exact_quantiles(pixels, ["aoi"], value, {"__median": 0.5, "__max": 1.0})
    if drop_unusable:
        areas = areas.where((F.col("n") >= MIN_DTM_PIXELS) & (F.col("__max") >= MIN_DTM_MAX))
    areas = areas.select("aoi", F.col("n").alias("n_valid"), "__median")
    filled = attach_small(pixels, areas, ["aoi"])
    if drop_unusable:
        filled = filled.withColumn(value, F.when(F.col("n_valid").isNotNull(), F.col(value)))
    return filled.withColumn(into, F.coalesce(F.col(value), F.col("__median"))).drop("__median")


# ---- global statistics and normalisation -----------------------------------


def unpivot_channels(
    pixels: DataFrame, channels=CHANNELS, keep: list[str] | None = None
) -> DataFrame:
    """One row per pixel and channel with a value."""
    keep = keep or ["aoi", "row", "col"]
    return pixels.unpivot(keep, list(channels), "channel", "value").where(
        F.col("value").isNotNull() & ~F.isnan("value")
    )


def stats_sample(pixels: DataFrame, channels=CHANNELS, per_area: int = 1000, seed=42) -> DataFrame:
    """At most ``per_area`` values per area and channel."""
    valid = lambda c: F.count(F.when(~F.isnan(c), F.col(c))).alias(c)
    counts = (
        pixels.groupBy("aoi")
        .agg(*[valid(c) for c in channels])
        .unpivot(["aoi"], list(channels), "channel", "__n")
    )
    limits = settle(hash_limits(counts, per_area), "limits")
    # The widest limit of an area drops most pixels before they are unpivoted.
    widest = limits.groupBy("aoi").agg(F.max("__limit").alias("__widest"))
    hashed = pixels.withColumn("__hash", seeded_hash(seed, F.col("row"), F.col("col")))
    near = hashed.join(widest, "aoi").where(
        F.substring("__hash", 1, 8) <= F.col("__widest")
    )
    long = unpivot_channels(near, channels, ["aoi", "row", "col", "__hash"])
    return sample_per_group(
        long, ["aoi", "channel"], ["row", "col"], per_area, seed, limits, "__hash"
    )


def global_stats(
    pixels: DataFrame,
    channels=CHANNELS,
    clip_percentile=(0.5, 99.5),
    per_area: int | None = None,
    seed=42,
    approx: bool = False,
    whole_group_rows: int = 500_000,
) -> DataFrame:
    """Robust mean and population deviation per channel.

    Values are clipped to the two percentiles first.  All pixels count, unless ``per_area``
    asks for a sample of so many values per area and channel.  A channel without data
    gets (0, 1, 0, 1), a flat channel a deviation of 1.  ``approx`` trades the
    exact percentiles for one mergeable sketch.
    """
    if per_area is None:
        values = unpivot_channels(pixels, channels)
    else:
        values = settle(
            stats_sample(pixels, channels, per_area, seed).select("channel", "value"), "sample"
        )
    low, high = (p / 100.0 for p in clip_percentile)
    if approx:
        q = F.percentile_approx("value", [low, high], 100_000)
        bounds = values.groupBy("channel").agg(q[0].alias("p_low"), q[1].alias("p_high"))
    else:
        wanted = {"p_low": low, "p_high": high}
        bounds = exact_quantiles(
            values, ["channel"], "value", wanted, whole_group_rows=whole_group_rows
        )
    # One row per channel name, so these two results are collected and stay tiny.
    range_of = {r["channel"]: (r["p_low"], r["p_high"]) for r in bounds.collect()}
    clipped = F.lit(None).cast("double")
    for c, (a, b) in range_of.items():
        inside = F.greatest(F.least(F.col("value"), F.lit(b)), F.lit(a))
        clipped = F.when(F.col("channel") == c, inside).otherwise(clipped)
    moments = values.groupBy("channel").agg(
        F.avg(clipped).alias("mean"), F.stddev_pop(clipped).alias("std")
    )
    found = {r["channel"]: (r["mean"], r["std"] or 1.0) for r in moments.collect()}
    rows = [(c, *found.get(c, (0.0, 1.0)), *range_of.get(c, (0.0, 1.0))) for c in channels]
    return pixels.sparkSession.createDataFrame(
        rows, "channel string, mean double, std double, p_low double, p_high double"
    )


def normalize_channels(pixels: DataFrame, stats: DataFrame, channels=CHANNELS) -> DataFrame:
    """Clip to the percentile range, then z-score; missing stays missing.

    The statistics are one row per channel and enter the plan as literals, so the
    pixels are neither joined nor shuffled.
    """
    at = {r["channel"]: r for r in stats.where(F.col("channel").isin(list(channels))).collect()}
    scaled = {
        c: (clip(F.col(c), F.lit(at[c]["p_low"]), F.lit(at[c]["p_high"])) - at[c]["mean"])
        / at[c]["std"]
        for c in channels
    }
    return pixels.withColumns(scaled)
