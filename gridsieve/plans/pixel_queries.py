"""Queries on bands and pixels: sources, masks, statistics, terrain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import channels as ch
from ..operators import correlation, resampling, terrain
from ..operators import results as rs
from ..session import scratch_path
from ..sources import readers, sinks
from . import tables as tb
from .registry import (
    AROUND,
    PX,
    SAMPLED,
    compose,
    normalized_sql,
    query,
    rounded,
    stats_sql,
    unpivot_sql,
)

RAW = """raw AS (
  SELECT printf('AOI_%04d', CAST(floor(event_id / 2500.0) AS INT)) AS aoi,
         CAST(floor((event_id % 2500) / 50.0) AS INT) AS row, CAST(event_id % 50 AS INT) AS col,
         CASE WHEN event_type = 'error' THEN -9999.0 ELSE value END AS elevation,
         CASE WHEN event_type <> 'error' THEN value END AS red,
         CAST(user_id AS DOUBLE) + 1 AS green, 4 * k AS nir,
         CASE WHEN k = 99 THEN 4294967295.0 ELSE k END AS acc,
         CASE WHEN event_id % 9 = 8 THEN 255.0 ELSE pow(2.0, event_id % 9) END AS dir
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events))"""
BASE = tb.BASE_CHANNELS


@query(
    "discover_aois",
    compose(
        [PX],
        "SELECT DISTINCT aoi, CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) AS aoi_index "
        "FROM px WHERE ndvi IS NOT NULL",
        "aoi, aoi_index",
    ),
)
def discover_aois(spark, sf):
    """NDVI files are written into the folders of their areas and found there by listing."""
    usable = tb.bands(spark, sf).where((F.col("band") == "ndvi") & F.col("value").isNotNull())
    root = scratch_path(spark, "bands")
    sinks.write_band_files(usable, root)
    return readers.areas_in_paths(readers.area_files(spark, root))


@query(
    "band_inventory",
    compose(
        [PX, unpivot_sql("px", BASE)],
        "SELECT aoi, CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) AS aoi_index, channel AS band, "
        "count(*) AS n FROM lng WHERE aoi IN ('AOI_0000', 'AOI_0001', 'AOI_0003') "
        "AND NOT (aoi = 'AOI_0001' AND channel = 'ndwi') GROUP BY ALL",
        "aoi, aoi_index, band, n",
    ),
)
def band_inventory(spark, sf):
    """Band files of three chosen areas, listed without opening the others, and their pixels."""
    root = scratch_path(spark, "bands")
    sinks.write_band_files(tb.bands(spark, sf).where(F.col("value").isNotNull()), root)
    chosen = ["AOI_0000", "AOI_0001", "AOI_0003"]
    files = readers.area_files(spark, root, chosen, "*.parquet")
    found = files.groupBy("aoi", "aoi_index", "band").agg(F.sum("length").alias("bytes"))
    counted = readers.read_by_area(spark, root, chosen).groupBy("aoi", "band").agg(F.count("value").alias("n"))
    return found.where("bytes > 0").join(counted, ["aoi", "band"]).select("aoi", "aoi_index", "band", "n")


@query(
    "areas_from_patch_files",
    compose([PX], "SELECT DISTINCT aoi FROM px", "aoi"),
)
def areas_from_patch_files(spark, sf):
    """Pooled patches in one dataset per area, named after it, found by listing."""
    sums = tb.pixels(spark, sf).groupBy("aoi").agg(F.count("ndvi").alias("n"))
    root = scratch_path(spark, "patch-files")
    named = sums.withColumn("file", F.concat("aoi", F.lit("_all_patches.npz")))
    named.write.partitionBy("file").parquet(root)
    return readers.areas_from_patch_files(readers.list_files(spark, root, "*.parquet"))


@query(
    "band_nodata_mask",
    compose([RAW], "SELECT aoi, row, col, nullif(elevation, -9999) AS value FROM raw",
            "aoi, row, col", "value"),
)
def band_nodata_mask(spark, sf):
    value = ch.without_nodata(F.col("elevation"), tb.NODATA)
    return rounded(tb.raw_pixels(spark, sf).select("aoi", "row", "col", value.alias("value")))


@query(
    "reference_grid",
    compose([PX], "SELECT aoi, CAST(max(row)+1 AS INT) AS height, CAST(max(col)+1 AS INT) AS width "
            "FROM px GROUP BY aoi", "aoi, height, width"),
)
def reference_grid(spark, sf):
    return ch.reference_grid(tb.pixels(spark, sf))


@query(
    "load_dataset_subset",
    compose([PX], "SELECT aoi, count(*) AS pixels, count(dtm) AS valid, sum(ndvi) AS ndvi_sum FROM px "
            "WHERE aoi IN ('AOI_0000', 'AOI_0002') GROUP BY aoi", "aoi, pixels, valid", "ndvi_sum"),
)
def load_dataset_subset(spark, sf):
    """A store partitioned by area, read back for a chosen list of areas."""
    from ..session import scratch_path

    path = scratch_path(spark, "pixels-by-area")
    bands = [F.floor(F.col(c) / 4096.0) for c in ("row", "col")]
    tb.pixels(spark, sf).repartition("aoi", *bands).write.partitionBy("aoi").parquet(path)
    chosen = readers.read_by_area(spark, path, ["AOI_0000", "AOI_0002"])
    return rounded(
        chosen.groupBy("aoi").agg(
            F.count(F.lit(1)).alias("pixels"),
            F.count("dtm").alias("valid"),
            F.sum("ndvi").alias("ndvi_sum"),
        )
    )


@query(
    "pick_input_file",
    compose(
        [],
        "SELECT band, min_by(name, ordinal) AS name FROM (SELECT event_type || '_' || "
        "CASE WHEN event_id % 3 = 0 THEN 'NDVI' WHEN event_id % 3 = 1 THEN 'Ndwi' ELSE 'B04' END "
        "|| '_' || event_id || '.tif' AS name, event_id AS ordinal FROM events) JOIN "
        "(VALUES ('ndvi'), ('ndwi')) b(band) ON contains(lower(name), band) GROUP BY band",
        "band, name",
    ),
)
def pick_input_file(spark, sf):
    ev = tb.table(spark, sf, "events")
    kind = F.col("event_id") % 3
    tag = F.when(kind == 0, "NDVI").when(kind == 1, "Ndwi").otherwise("B04")
    names = ev.select(
        F.concat("event_type", F.lit("_"), tag, F.lit("_"), F.col("event_id").cast("string"), F.lit(".tif")).alias("name"),
        F.col("event_id").alias("ordinal"),
    )
    picks = [
        readers.pick_input_file(names, b, required=True).select(F.lit(b).alias("band"), "name")
        for b in ("ndvi", "ndwi")
    ]
    return picks[0].unionByName(picks[1])


@query(
    "assemble_channels",
    compose(
        [PX],
        "SELECT aoi, row, col, dtm, ndvi, CASE WHEN aoi <> 'AOI_0001' THEN ndwi END AS ndwi, "
        "flow_acc, flow_dir FROM px",
        "aoi, row, col", "dtm, ndvi, ndwi, flow_acc, flow_dir",
    ),
)
def assemble_channels(spark, sf):
    return rounded(ch.align_bands(tb.bands(spark, sf), BASE))


@query(
    "resample_bilinear",
    compose(
        [PX,
         "dims AS (SELECT aoi, max(row)+1 AS h, max(col)+1 AS w FROM px GROUP BY aoi)",
         "tg AS (SELECT aoi, r AS row, c AS col, (r + 0.5) * h / 73.0 - 0.5 AS sr, "
         "(c + 0.5) * w / 73.0 - 0.5 AS sc FROM dims, (SELECT unnest(generate_series(0, 72)) AS r), "
         "(SELECT unnest(generate_series(0, 72)) AS c))",
         "nbr AS (SELECT tg.aoi, tg.row, tg.col, dtm, "
         "(CASE WHEN dr = 0 THEN 1 - (sr - floor(sr)) ELSE sr - floor(sr) END) * "
         "(CASE WHEN dc = 0 THEN 1 - (sc - floor(sc)) ELSE sc - floor(sc) END) AS wt FROM tg "
         "JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) k(dr, dc) ON TRUE "
         "LEFT JOIN px ON px.aoi = tg.aoi AND px.row = floor(sr) + dr AND px.col = floor(sc) + dc)"],
        "SELECT aoi, CAST(row AS INT) AS row, CAST(col AS INT) AS col, "
        "sum(dtm * wt) / nullif(sum(CASE WHEN dtm IS NOT NULL THEN wt END), 0) AS dtm "
        "FROM nbr GROUP BY aoi, row, col",
        "aoi, row, col", "dtm",
    ),
)
def resample_bilinear(spark, sf):
    """Elevation of every area on a finer grid of 73 by 73 cells."""
    px = tb.pixels(spark, sf)
    dims = ch.reference_grid(px)
    line = F.sequence(F.lit(0), F.lit(72))
    at = lambda cell, n: (F.col(cell) + 0.5) * F.col(n) / 73.0 - 0.5
    target = (
        dims.withColumn("row", F.explode(line))
        .repartition("aoi", "row")
        .withColumn("col", F.explode(line))
        .select("aoi", "row", "col", at("row", "height").alias("src_row"), at("col", "width").alias("src_col"))
    )
    return rounded(ch.resample(px.select("aoi", "row", "col", "dtm"), target, "dtm"))


# A target of 40 by 40 cells, turned by 30 degrees, stretched and sheared.
# Short decimals would put positions or values on the edge of rounding, which engines decide
# in different ways.
_TURN = {
    "a": 1.0392304845413, "b": -0.4512345678917, "c": 9.7135792468139,
    "d": 0.6012345678911, "e": 0.8660254037843, "f": -2.4135792468133,
}


@query(
    "resample_rotated",
    compose(
        [PX,
         "tg AS (SELECT aoi, r AS row, c AS col, "
         "round({d} * c + {e} * r + ({f}), 9) AS sr, round({a} * c + ({b}) * r + {c}, 9) AS sc "
         "FROM (SELECT DISTINCT aoi FROM px), (SELECT CAST(unnest(generate_series(0, 39)) AS DOUBLE) AS r), "
         "(SELECT CAST(unnest(generate_series(0, 39)) AS DOUBLE) AS c))".format(
             **{k: f"CAST({v} AS DOUBLE)" for k, v in _TURN.items()}
         ),
         "nbr AS (SELECT tg.aoi, tg.row, tg.col, dtm, ndvi, "
         "(CASE WHEN dr = 0 THEN 1 - (sr - floor(sr)) ELSE sr - floor(sr) END) * "
         "(CASE WHEN dc = 0 THEN 1 - (sc - floor(sc)) ELSE sc - floor(sc) END) AS wt FROM tg "
         "JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) k(dr, dc) ON TRUE "
         "LEFT JOIN px ON px.aoi = tg.aoi AND px.row = floor(sr) + dr AND px.col = floor(sc) + dc)"],
        "SELECT aoi, CAST(row AS INT) AS row, CAST(col AS INT) AS col, "
        "sum(dtm * wt) / nullif(sum(CASE WHEN dtm IS NOT NULL THEN wt END), 0) AS dtm, "
        "sum(ndvi * wt) / nullif(sum(CASE WHEN ndvi IS NOT NULL THEN wt END), 0) AS ndvi "
        "FROM nbr GROUP BY aoi, row, col",
        "aoi, row, col", "dtm, ndvi",
    ),
)
def resample_rotated(spark, sf):
    """Two channels of every area on a turned and sheared grid."""
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm", "ndvi")
    sized = {"height": F.lit(40), "width": F.lit(40)}
    grids = px.select("aoi").distinct().withColumns(sized | {k: F.lit(v) for k, v in _TURN.items()})
    return rounded(resampling.resample_affine(px, grids, ["dtm", "ndvi"]))


# A fixed template of twelve by twelve cells.
_LARGE = np.array([[(5 * i + 3 * j) % 11 - 5 for j in range(12)] for i in range(12)])


@query(
    "template_field",
    compose(
        [PX,
         "tpl AS (SELECT i, j, CAST((5 * i + 3 * j) % 11 - 5 AS DOUBLE) AS t FROM "
         "(SELECT unnest(generate_series(0, 11)) AS i), (SELECT unnest(generate_series(0, 11)) AS j))",
         "win AS (SELECT s.aoi, s.row - i AS row, s.col - j AS col, coalesce(s.dtm, 0) AS v, t FROM px s, tpl "
         "WHERE s.row >= i AND s.col >= j)"],
        "SELECT aoi, CAST(row AS INT) AS row, CAST(col AS INT) AS col, "
        "sum(v * t) / (sqrt(sum(v * v)) * sqrt(sum(t * t)) + 1e-10) AS similarity "
        "FROM win GROUP BY aoi, row, col HAVING count(*) = 144",
        "aoi, row, col", "similarity",
    ),
)
def template_field(spark, sf):
    """Similarity of the elevation around every pixel to a large template."""
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(correlation.template_field(px, _LARGE, "dtm"))


# ---- band expressions ------------------------------------------------------


@query(
    "dtm_mask",
    compose([RAW], "SELECT aoi, row, col, CASE WHEN elevation > 0 THEN elevation END AS dtm FROM raw",
            "aoi, row, col", "dtm"),
)
def dtm_mask(spark, sf):
    return rounded(
        tb.raw_pixels(spark, sf).select(
            "aoi", "row", "col", ch.positive_only(F.col("elevation")).alias("dtm")
        )
    )


@query(
    "flow_acc_log",
    compose([PX], "SELECT aoi, row, col, flow_acc FROM px", "aoi, row, col", "flow_acc"),
)
def flow_acc_log(spark, sf):
    return rounded(
        tb.raw_pixels(spark, sf).select(
            "aoi", "row", "col", ch.log_flow_acc(F.col("acc")).alias("flow_acc")
        )
    )


@query(
    "flow_dir_sin",
    compose([PX], "SELECT aoi, row, col, flow_dir FROM px", "aoi, row, col", "flow_dir"),
)
def flow_dir_sin(spark, sf):
    return rounded(
        tb.raw_pixels(spark, sf).select(
            "aoi", "row", "col", ch.flow_dir_sine(F.col("dir")).alias("flow_dir")
        )
    )


@query(
    "ndvi_ndwi",
    compose([PX], "SELECT aoi, row, col, ndvi, ndwi FROM px", "aoi, row, col", "ndvi, ndwi"),
)
def ndvi_ndwi(spark, sf):
    raw = tb.raw_pixels(spark, sf)
    return rounded(
        raw.select(
            "aoi",
            "row",
            "col",
            ch.ndvi(F.col("nir"), F.col("red")).alias("ndvi"),
            ch.ndwi(F.col("green"), F.col("nir")).alias("ndwi"),
        )
    )


# ---- statistics ------------------------------------------------------------


@query(
    "dtm_aoi_stats",
    compose([PX], "SELECT aoi, count(dtm) AS valid, max(dtm) AS max_dtm, count(dtm) > 0 AS dtm_valid, "
            "median(dtm) AS median_dtm FROM px GROUP BY aoi",
            "aoi, valid, dtm_valid", "max_dtm, median_dtm"),
)
def dtm_aoi_stats(spark, sf):
    return rounded(ch.dtm_area_stats(tb.pixels(spark, sf)))


@query(
    "dtm_aoi_gate",
    compose(
        [PX, "g AS (SELECT aoi, count(dtm) >= 100 AND max(dtm) >= 0.1 AS ok FROM px GROUP BY aoi)"],
        "SELECT aoi, row, col, CASE WHEN ok THEN dtm END AS dtm FROM px JOIN g USING (aoi)",
        "aoi, row, col", "dtm",
    ),
)
def dtm_aoi_gate(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(ch.drop_unusable_dtm(px))


@query(
    "median_fill",
    compose([PX, "m AS (SELECT aoi, median(dtm) AS md FROM px GROUP BY aoi)"],
            "SELECT aoi, row, col, coalesce(dtm, md) AS filled FROM px JOIN m USING (aoi)",
            "aoi, row, col", "filled"),
)
def median_fill(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(ch.fill_with_median(px).select("aoi", "row", "col", "filled"))


@query(
    "stats_sample",
    compose([PX, unpivot_sql("px", BASE), SAMPLED],
            "SELECT aoi, channel, row, col, value FROM smp", "aoi, channel, row, col", "value"),
)
def stats_sample(spark, sf):
    return rounded(ch.stats_sample(tb.pixels(spark, sf), BASE)).select(
        "aoi", "channel", "row", "col", "value"
    )


@query(
    "global_stats",
    compose([PX, unpivot_sql("px", BASE), stats_sql("lng")],
            "SELECT * FROM st", "channel", "mean, std, p_low, p_high"),
)
def global_stats(spark, sf):
    return rounded(ch.global_stats(tb.pixels(spark, sf), BASE))


@query(
    "global_stats_ranks",
    compose([PX, unpivot_sql("px", BASE), stats_sql("lng")],
            "SELECT * FROM st", "channel", "mean, std, p_low, p_high"),
)
def global_stats_ranks(spark, sf):
    """The way taken when a channel has many values: ranks narrowed down by histograms."""
    return rounded(ch.global_stats(tb.pixels(spark, sf), BASE, whole_group_rows=0))


@query(
    "global_stats_sampled",
    compose([PX, unpivot_sql("px", BASE), SAMPLED, stats_sql("smp")],
            "SELECT * FROM st", "channel", "mean, std, p_low, p_high"),
)
def global_stats_sampled(spark, sf):
    """The opt-in sample of 1,000 values per area and channel."""
    return rounded(ch.global_stats(tb.pixels(spark, sf), BASE, per_area=1000))


@query(
    "global_stats_full",
    compose([PX, unpivot_sql("px", BASE), stats_sql("lng")],
            "SELECT * FROM st", "channel", "mean, std, p_low, p_high"),
)
def global_stats_full(spark, sf):
    """The same statistics over every pixel instead of the sample."""
    return rounded(ch.global_stats(tb.pixels(spark, sf), BASE, per_area=None))


@query(
    "normalize_channels",
    compose([PX, unpivot_sql("px", BASE), stats_sql("lng"), normalized_sql("px", BASE)],
            "SELECT * FROM nm", "aoi, row, col", ", ".join(BASE)),
)
def normalize_channels(spark, sf):
    px = tb.pixels(spark, sf)
    return rounded(ch.normalize_channels(px, ch.global_stats(px, BASE), BASE))


# ---- terrain ---------------------------------------------------------------


@query(
    "slope",
    compose([PX, AROUND], "SELECT aoi, row, col, slope FROM ter", "aoi, row, col", "slope"),
)
def slope(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(terrain.terrain_derivatives(px).select("aoi", "row", "col", "slope"))


@query(
    "roughness",
    compose([PX, AROUND], "SELECT aoi, row, col, roughness FROM ter", "aoi, row, col", "roughness"),
)
def roughness(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(terrain.terrain_derivatives(px).select("aoi", "row", "col", "roughness"))


def _mirror(x: str, n: str) -> str:
    """Line ``x`` folded into ``0..n-1`` with the edge line repeated."""
    m = f"((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n})"
    return f"CASE WHEN {m} >= {n} THEN 2 * {n} - 1 - {m} ELSE {m} END"


@query(
    "roughness_window5",
    compose(
        [PX, "med AS (SELECT aoi, median(dtm) AS m, max(row)+1 AS h, max(col)+1 AS w FROM px GROUP BY aoi)",
         "fl AS (SELECT px.aoi, row, col, dtm, coalesce(dtm, m) AS f, h, w FROM px JOIN med USING (aoi))",
         "off AS (SELECT unnest(generate_series(-2, 2)) AS d)",
         "tap AS (SELECT fl.aoi, fl.row, fl.col, fl.dtm, "
         + _mirror("fl.row + a.d", "fl.h") + " AS sr, " + _mirror("fl.col + b.d", "fl.w") + " AS sc "
         "FROM fl, off a, off b)"],
        "SELECT tap.aoi, tap.row, tap.col, CASE WHEN any_value(tap.dtm) IS NOT NULL THEN stddev_pop(s.f) END "
        "AS roughness FROM tap JOIN fl s ON s.aoi = tap.aoi AND s.row = tap.sr AND s.col = tap.sc "
        "GROUP BY tap.aoi, tap.row, tap.col",
        "aoi, row, col", "roughness",
    ),
)
def roughness_window5(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(terrain.roughness_window(px, 5))


@query(
    "hillshade",
    compose(
        [PX, AROUND,
         "hs AS (SELECT aoi, row, col, dtm, atan(sqrt(gx*gx + gy*gy) / 8.0) AS sl, "
         "atan2(-gy / 8.0, gx / 8.0) AS asp FROM gr)"],
        "SELECT *, CAST(CASE WHEN dtm IS NULL THEN 128 ELSE floor((shade + 1) / 2.0 * 255) END AS INT) "
        "AS shade_byte FROM (SELECT aoi, row, col, dtm, sl AS slope_rad, greatest(least((4 * sin(radians(45.0)) * sin(sl) + "
        "cos(radians(45.0)) * cos(sl) * (cos(radians(315.0) - asp) + cos(radians(45.0) - asp) + "
        "cos(radians(225.0) - asp) + cos(radians(135.0) - asp))) / 4.0, 1.0), -1.0) AS shade FROM hs)",
        "aoi, row, col, shade_byte", "slope_rad, shade",
    ),
)
def hillshade(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(terrain.hillshade(px).select("aoi", "row", "col", "slope_rad", "shade", "shade_byte"))


@query(
    "local_relief",
    compose(
        [PX, "med AS (SELECT aoi, median(dtm) AS m, max(row)+1 AS h, max(col)+1 AS w FROM px GROUP BY aoi)",
         "fl AS (SELECT px.aoi, row, col, coalesce(dtm, m) AS f, h, w FROM px JOIN med USING (aoi))",
         "kn AS (SELECT d, exp(-0.5 * pow(d / 10.0, 2)) / (SELECT sum(exp(-0.5 * pow(e / 10.0, 2))) "
         "FROM (SELECT unnest(generate_series(-40, 40)) AS e)) AS wt "
         "FROM (SELECT unnest(generate_series(-40, 40)) AS d))",
         "v1 AS (SELECT t.aoi, t.row, t.col, t.w, sum(s.f * t.wt) AS g FROM (SELECT fl.*, wt, "
         + _mirror("row + d", "h") + " AS sr FROM fl, kn) t JOIN fl s ON s.aoi = t.aoi AND "
         "s.row = t.sr AND s.col = t.col GROUP BY t.aoi, t.row, t.col, t.w)",
         "v2 AS (SELECT t.aoi, t.row, t.col, sum(s.g * t.wt) AS g FROM (SELECT v1.*, wt, "
         + _mirror("col + d", "w") + " AS sc FROM v1, kn) t JOIN v1 s ON s.aoi = t.aoi AND "
         "s.row = t.row AND s.col = t.sc GROUP BY t.aoi, t.row, t.col)"],
        "SELECT aoi, row, col, f - g AS relief, (greatest(least(f - g, 2.0), -2.0) + 2) / 4.0 "
        "AS relief_scaled FROM fl JOIN v2 USING (aoi, row, col)",
        "aoi, row, col", "relief, relief_scaled",
    ),
)
def local_relief(spark, sf):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", "dtm")
    return rounded(terrain.local_relief(px).drop("dtm"))


@query(
    "percentile_stretch",
    compose(
        [PX, "b AS (SELECT aoi, quantile_cont(dtm, 0.02) AS lo, quantile_cont(dtm, 0.98) AS hi "
         "FROM px GROUP BY aoi)"],
        "SELECT aoi, row, col, CASE WHEN dtm IS NOT NULL THEN "
        "greatest(least((dtm - lo) / nullif(hi - lo, 0), 1.0), 0.0) END AS stretched "
        "FROM px JOIN b USING (aoi)",
        "aoi, row, col", "stretched",
    ),
)
def percentile_stretch(spark, sf):
    return rounded(terrain.percentile_stretch(tb.pixels(spark, sf)))


@query(
    "union_aois",
    compose([PX], "SELECT aoi, count(*) AS pixels FROM px GROUP BY aoi", "aoi, pixels"),
)
def union_aois(spark, sf):
    """Parts read separately and put back together."""
    px = tb.pixels(spark, sf).select("aoi", "row", "col")
    first = px.where("aoi <= 'AOI_0001'")
    rest = px.where("aoi > 'AOI_0001'")
    return first.unionByName(rest).groupBy("aoi").agg(F.count(F.lit(1)).alias("pixels"))


GOOD = "good AS (SELECT aoi FROM px GROUP BY aoi HAVING count(dtm) >= 1990)"


def _usable_areas(px):
    return px.groupBy("aoi").agg(F.count("dtm").alias("n")).where("n >= 1990").select("aoi")


@query(
    "failed_aois",
    compose([PX, GOOD], "SELECT DISTINCT aoi FROM px WHERE aoi NOT IN (SELECT aoi FROM good)", "aoi"),
)
def failed_aois(spark, sf):
    """Areas that yielded no usable elevation while the others went on."""
    px = tb.pixels(spark, sf)
    return rs.missing_areas(px, _usable_areas(px))


@query(
    "processing_summary",
    compose(
        [PX, GOOD, "a AS (SELECT aoi, aoi IN (SELECT aoi FROM good) AS ok FROM (SELECT DISTINCT aoi FROM px))"],
        "SELECT count(*) FILTER (WHERE ok) AS successful, count(*) FILTER (WHERE NOT ok) AS failed, "
        "avg(CAST(ok AS INT)) * 100 AS success_rate FROM a",
        "successful, failed", "success_rate",
    ),
)
def processing_summary(spark, sf):
    px = tb.pixels(spark, sf)
    return rounded(rs.processing_summary(px, _usable_areas(px)))
