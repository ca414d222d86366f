"""Queries on patches cut from pixels, and on mosaics put together from them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions.scalars import (
    interpolate_lat,
    interpolate_lon,
    minmax_eps,
    patch_bounds,
    sanitize_array,
)
from ..operators import channels as ch
from ..operators import evaluation as ev
from ..operators import mosaic, quality
from ..operators import patches as pt
from ..operators import results as rs
from ..operators.models import autoencoder, embedding
from ..session import attach_small, settle
from . import scoring
from . import tables as tb
from .registry import (
    AROUND,
    EXTENT,
    PX,
    SC,
    compose,
    cut_sql,
    normalized_sql,
    query,
    rounded,
    stats_sql,
    unpivot_sql,
)

BASE = tb.BASE_CHANNELS
GRID = tb.PIXEL_GRID
P = GRID.patch

# Fixed small kernels for template matching.
TEMPLATES = {
    "ring": np.array([[1, 1, 1], [1, 0, 1], [1, 1, 1]]),
    "line": np.array([[0, 1, 0], [0, 1, 0], [0, 1, 0]]),
    "block": np.array([[1, 1, 1], [1, 1, 1], [1, 1, 1]]),
}


def _raw_patches(spark, sf, channels=BASE):
    px = tb.pixels(spark, sf).select("aoi", "row", "col", *channels)
    return pt.extract_patches(px, GRID, tb.MIN_VALID, channels)


# ---- cutting ---------------------------------------------------------------


@query(
    "valid_patches",
    compose([PX, cut_sql("px")],
            "SELECT DISTINCT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, n_valid FROM pp",
            "aoi, row, col, n_valid"),
)
def valid_patches(spark, sf):
    return pt.valid_patches(tb.pixels(spark, sf), GRID, tb.MIN_VALID)


def _digest(cells, channels):
    """Count, sum and position-weighted sum of every channel, so order matters."""
    place = F.col("pr") * P + F.col("pc") + 1
    out = [F.max("n_valid").alias("n_valid")]
    for c in channels:
        out += [
            F.count(c).alias(f"{c}_n"),
            F.sum(c).alias(f"{c}_s"),
            F.sum(F.col(c) * place).alias(f"{c}_w"),
        ]
    return cells.groupBy("aoi", "row", "col").agg(*out)


def _digest_sql(channels):
    cells = ", ".join(
        f"count({c}) AS {c}_n, sum({c}) AS {c}_s, sum({c} * (pr * 16 + pc + 1)) AS {c}_w"
        for c in channels
    )
    plain = "aoi, row, col, n_valid, " + ", ".join(f"{c}_n" for c in channels)
    exact = ", ".join(f"{c}_s, {c}_w" for c in channels)
    body = (
        "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, max(n_valid) AS n_valid, "
        f"{cells} FROM pp GROUP BY aoi, r0, c0"
    )
    return body, plain, exact


@query(
    "extract_patches",
    compose(
        [PX, unpivot_sql("px", BASE), stats_sql("lng"), normalized_sql("px", BASE), cut_sql("nm")],
        *_digest_sql(BASE),
    ),
)
def extract_patches(spark, sf):
    px = tb.pixels(spark, sf)
    normal = ch.normalize_channels(px, ch.global_stats(px, BASE), BASE)
    cut = pt.extract_patches(normal, GRID, tb.MIN_VALID, BASE)
    return rounded(_digest(pt.explode_patches(cut, P, BASE), BASE))


@query(
    "mean_pool",
    compose(
        [PX, cut_sql("px")],
        "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, max(n_valid) AS n_valid, "
        + ", ".join(f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std" for c in BASE)
        + " FROM pp GROUP BY aoi, r0, c0",
        "aoi, row, col, n_valid",
        ", ".join(f"{c}_mean, {c}_std" for c in BASE),
    ),
)
def mean_pool(spark, sf):
    """Patch features from block sums, without copying a pixel."""
    return rounded(pt.mean_pool_channels(tb.pixels(spark, sf), GRID, tb.MIN_VALID, BASE))


@query(
    "sanitize_patches",
    compose([PX, cut_sql("px")],
            "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, avg(coalesce(ndvi, 0)) AS ndvi_mean, "
            "avg(coalesce(flow_acc, 0)) AS flow_acc_mean FROM pp GROUP BY aoi, r0, c0",
            "aoi, row, col", "ndvi_mean, flow_acc_mean"),
)
def sanitize_patches(spark, sf):
    pair = ("ndvi", "flow_acc")
    clean = pt.sanitize_patches(_raw_patches(spark, sf, pair), pair)
    return rounded(
        pt.pool_arrays(clean, pair).select("aoi", "row", "col", "ndvi_mean", "flow_acc_mean")
    )


ORD = """od AS (SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, n_valid,
  row_number() OVER (PARTITION BY aoi ORDER BY r0, c0) - 1 AS ordinal FROM ok)"""


@query(
    "patch_ids",
    compose([PX, cut_sql("px"), ORD],
            "SELECT *, printf('%s_p%03d', aoi, ordinal) AS patch_id FROM od",
            "aoi, row, col, ordinal, patch_id"),
)
def patch_ids(spark, sf):
    kept = pt.valid_patches(tb.pixels(spark, sf), GRID, tb.MIN_VALID)
    return pt.number_patches(kept).select("aoi", "row", "col", "ordinal", "patch_id")


@query(
    "sample_patches",
    compose(
        [PX, cut_sql("px"),
         "rk AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY md5('42|' || r0 || '|' || c0)) AS rn FROM ok)"],
        "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col FROM rk WHERE rn <= 10",
        "aoi, row, col",
    ),
)
def sample_patches(spark, sf):
    kept = pt.valid_patches(tb.pixels(spark, sf), GRID, tb.MIN_VALID)
    return pt.sample_patches(kept, 10).select("aoi", "row", "col")


@query(
    "aoi_info",
    compose([PX, cut_sql("px")],
            "SELECT aoi, count(*) AS patches, 256 AS patch_pixels, 5 AS channels FROM ok GROUP BY aoi",
            "aoi, patches, patch_pixels, channels"),
)
def aoi_info(spark, sf):
    return rs.area_info(_raw_patches(spark, sf), BASE)


@query(
    "elevation_stats",
    compose([PX, cut_sql("px")],
            "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, min(dtm) AS min_elevation, "
            "max(dtm) AS max_elevation, max(dtm) - min(dtm) AS relief, avg(dtm) AS mean_elevation, "
            "stddev_pop(dtm) AS std_elevation FROM pp GROUP BY aoi, r0, c0",
            "aoi, row, col", "min_elevation, max_elevation, relief, mean_elevation, std_elevation"),
)
def elevation_stats(spark, sf):
    cells = pt.explode_patches(_raw_patches(spark, sf, ("dtm", "ndvi")), P, ("dtm", "ndvi"))
    return rounded(ev.elevation_stats(cells, ["aoi", "row", "col"]))


@query(
    "channel_quick_stats",
    compose([PX, cut_sql("px"), unpivot_sql("pp", BASE)],
            "SELECT channel, avg(value) AS mean, stddev_pop(value) AS std FROM lng GROUP BY channel",
            "channel", "mean, std"),
)
def channel_quick_stats(spark, sf):
    cells = pt.explode_patches(_raw_patches(spark, sf), P, BASE)
    return rounded(ev.channel_quick_stats(cells, BASE))


@query(
    "dq_patch_shape",
    compose([PX, cut_sql("px")],
            "SELECT count(*) AS patches, CAST(0 AS BIGINT) AS malformed_16, count(*) AS malformed_32 FROM ok",
            "patches, malformed_16, malformed_32"),
)
def dq_patch_shape(spark, sf):
    """All cut patches have 16 x 16 cells, so all break a rule asking for 32 x 32."""
    cut = settle(_raw_patches(spark, sf), "patches")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).scalar()
    return cut.agg(F.count(F.lit(1)).alias("patches")).withColumns(
        {
            "malformed_16": count(quality.malformed_patches(cut, 16, BASE), "n"),
            "malformed_32": count(quality.malformed_patches(cut, 32, BASE), "n"),
        }
    )


# ---- positions -------------------------------------------------------------


@query(
    "patch_center",
    compose([SC], "SELECT patch_id, row + 32 AS center_row, col + 32 AS center_col FROM sc",
            "patch_id, center_row, center_col"),
)
def patch_center(spark, sf):
    return tb.scores_only(spark, sf).select(
        "patch_id",
        (F.col("row") + 32).alias("center_row"),
        (F.col("col") + 32).alias("center_col"),
    )


@query(
    "patch_bounds",
    compose([SC], "SELECT patch_id, row AS row_start, row + 64 AS row_end, col AS col_start, "
            "col + 64 AS col_end FROM sc", "patch_id, row_start, row_end, col_start, col_end"),
)
def patch_bounds_query(spark, sf):
    b = patch_bounds(F.col("row"), F.col("col"), 64)
    return tb.scores_only(spark, sf).select("patch_id", b.alias("b")).select("patch_id", "b.*")


@query(
    "broadcast_scores",
    compose(
        [SC, "cells AS (SELECT unnest(generate_series(0, 255)) AS cell)"],
        "SELECT patch_id, CAST(floor(cell / 16) AS INT) AS pr, CAST(cell % 16 AS INT) AS pc, "
        "gate_prediction AS score FROM sc, cells",
        "patch_id, pr, pc", "score",
    ),
)
def broadcast_scores(spark, sf):
    s = tb.scores_only(spark, sf).select("patch_id", F.col("gate_prediction").alias("score"))
    return rounded(pt.broadcast_to_pixels(s, P, "score"))


# ---- reconstruction and matching -------------------------------------------

MEANS = (
    "mp AS (SELECT pr, pc, " + ", ".join(f"avg({c}) AS m_{c}" for c in BASE) + " FROM pp GROUP BY pr, pc)"
)


def _mse_sql(channels):
    """Patch error against the mean patch over all valid cells."""
    total = " + ".join(f"coalesce(pow({c} - m_{c}, 2), 0)" for c in channels)
    n = " + ".join(f"count({c})" for c in channels)
    return (
        f"er AS (SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, max(n_valid) AS n_valid, "
        f"sum({total}) / nullif({n}, 0) AS mse FROM pp JOIN mp USING (pr, pc) GROUP BY aoi, r0, c0)"
    )


NORMAL = [PX, unpivot_sql("px", BASE), stats_sql("lng"), normalized_sql("px", BASE), cut_sql("nm")]


def _normal_patches(spark, sf):
    px = tb.pixels(spark, sf)
    normal = ch.normalize_channels(px, ch.global_stats(px, BASE), BASE)
    return settle(pt.extract_patches(normal, GRID, tb.MIN_VALID, BASE), "patches")


@query(
    "recon_mean_mse",
    compose([*NORMAL, MEANS, _mse_sql(BASE)], "SELECT * FROM er", "aoi, row, col, n_valid", "mse"),
)
def recon_mean_mse(spark, sf):
    """Error of each patch against the mean patch, the zero-component autoencoder."""
    px = tb.pixels(spark, sf)
    normal = settle(ch.normalize_channels(px, ch.global_stats(px, BASE), BASE), "normal")
    return rounded(
        scoring.scored_patches(normal, GRID, tb.MIN_VALID, BASE).select(
            "aoi", "row", "col", "n_valid", "mse"
        )
    )


@query(
    "ae_score_online",
    compose([*NORMAL, MEANS, _mse_sql(BASE)],
            "SELECT aoi, row, col, 1 / (1 + exp(-10 * mse)) AS score FROM er", "aoi, row, col", "score"),
)
def ae_score_online(spark, sf):
    out = scoring.reconstruction_candidates(_normal_patches(spark, sf), BASE)
    return rounded(out.select("aoi", "row", "col", "score"))


def _normal_pixels(spark, sf):
    """Normalised pixels and the mean patch, for errors over all channels."""
    px = tb.pixels(spark, sf)
    normal = settle(ch.normalize_channels(px, ch.global_stats(px, BASE), BASE), "normal")
    return normal, embedding.mean_patch_of_pixels(normal, GRID, tb.MIN_VALID, BASE)


def _patch_errors(spark, sf):
    normal, template = _normal_pixels(spark, sf)
    return embedding.patch_errors_of_pixels(normal, GRID, template, tb.MIN_VALID, BASE)


def _cells(patches, value):
    """One row per pixel of an array with a value for each."""
    rows = patches.select("aoi", "row", "col", F.posexplode(value).alias("pos", value))
    return rows.select(
        "aoi", "row", "col", F.floor(F.col("pos") / F.lit(float(P))).cast("int").alias("pr"),
        (F.col("pos") % P).cast("int").alias("pc"), value,
    )


def _gaps_sql(fn: str) -> str:
    """Channel mean of an error of sanitised cells against the mean patch."""
    return "(" + " + ".join(fn.format(f"(coalesce({c}, 0) - coalesce(m_{c}, 0))") for c in BASE) + f") / {len(BASE)}"


ABSOLUTE, SQUARED = _gaps_sql("abs({})"), _gaps_sql("pow({}, 2)")


@query(
    "abs_error",
    compose([*NORMAL, MEANS],
            "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, CAST(pr AS INT) AS pr, "
            f"CAST(pc AS INT) AS pc, {ABSOLUTE} AS abs_error FROM pp JOIN mp USING (pr, pc)",
            "aoi, row, col, pr, pc", "abs_error"),
)
def abs_error(spark, sf):
    """Channel mean of the absolute error of every pixel of every patch."""
    return rounded(_cells(_patch_errors(spark, sf), "abs_error"))


@query(
    "ae_mse",
    compose([*NORMAL, MEANS],
            f"SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, avg({SQUARED}) AS mse "
            "FROM pp JOIN mp USING (pr, pc) GROUP BY aoi, r0, c0", "aoi, row, col", "mse"),
)
def ae_mse(spark, sf):
    """Squared error of every patch over all pixels and channels."""
    return rounded(_patch_errors(spark, sf).select("aoi", "row", "col", "mse"))



@query(
    "ae_uncertainty",
    compose([SC, "cells AS (SELECT patch_id, unnest(embedding) AS r FROM sc)"],
            "SELECT patch_id, avg(1 - 2 * abs(1 / (1 + exp(-4 * CAST(r AS DOUBLE))) - 0.5)) AS uncertainty "
            "FROM cells GROUP BY patch_id", "patch_id", "uncertainty"),
)
def ae_uncertainty(spark, sf):
    """Vector elements squashed to (0, 1) stand for a reconstruction."""
    recon = F.transform(
        "embedding", lambda x: F.lit(1.0) / (F.lit(1.0) + F.exp(x.cast("double") * -4.0))
    )
    rows = tb.patch_scores(spark, sf).select("patch_id", recon.alias("recon"))
    return rounded(
        rows.select("patch_id", embedding.array_uncertainty(F.col("recon")).alias("uncertainty"))
    )


CORR = """x0 AS (SELECT aoi, r0, c0, pr, pc, coalesce(dtm, 0) AS x FROM pp),
taps(t, dy, dx, w) AS (VALUES
  ('ring',0,0,1),('ring',0,1,1),('ring',0,2,1),('ring',1,0,1),('ring',1,1,0),('ring',1,2,1),
  ('ring',2,0,1),('ring',2,1,1),('ring',2,2,1),
  ('line',0,0,0),('line',0,1,1),('line',0,2,0),('line',1,0,0),('line',1,1,1),('line',1,2,0),
  ('line',2,0,0),('line',2,1,1),('line',2,2,0),
  ('block',0,0,1),('block',0,1,1),('block',0,2,1),('block',1,0,1),('block',1,1,1),('block',1,2,1),
  ('block',2,0,1),('block',2,1,1),('block',2,2,1)),
tn AS (SELECT t, sqrt(sum(w * w)) AS tl FROM taps GROUP BY t),
xn AS (SELECT aoi, r0, c0, sqrt(sum(x * x)) AS xl FROM x0 GROUP BY aoi, r0, c0),
co AS (SELECT aoi, r0, c0, t, sum(x * w) AS v FROM x0, taps WHERE pr - dy BETWEEN 0 AND 13
       AND pc - dx BETWEEN 0 AND 13 GROUP BY aoi, r0, c0, t, pr - dy, pc - dx),
sm AS (SELECT aoi, r0, c0, max(mv / (xl * tl + 1e-10)) AS s FROM
       (SELECT aoi, r0, c0, t, max(v) AS mv FROM co GROUP BY aoi, r0, c0, t)
       JOIN tn USING (t) JOIN xn USING (aoi, r0, c0) GROUP BY aoi, r0, c0)"""


@query(
    "template_match",
    compose([PX, cut_sql("px"), CORR],
            "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, s AS similarity, "
            "(s - min(s) OVER a) / (max(s) OVER a - min(s) OVER a + 1e-10) AS prob FROM sm "
            "WINDOW a AS (PARTITION BY aoi)",
            "aoi, row, col", "similarity, prob"),
)
def template_match(spark, sf):
    """Correlation with templates, scaled within each area."""
    cut = _raw_patches(spark, sf, ("dtm", "ndvi"))
    out = embedding.template_match(cut, P, TEMPLATES, into="similarity")
    out = settle(out.select("aoi", "row", "col", "similarity"), "matches")
    scaled = attach_small(out, ev.area_bounds(out, "similarity"), ["aoi"]).withColumn(
        "prob", minmax_eps(F.col("similarity"), F.col("lo"), F.col("hi"))
    )
    return rounded(scaled.drop("lo", "hi"))


@query("patch_embedding")
def patch_embedding(spark, sf):
    """Channel moments of every patch, projected on eight components."""
    moments = settle(
        embedding.patch_moment_vector(_normal_patches(spark, sf), BASE, "moments").drop(*BASE), "moments"
    )
    model = embedding.fit_pca(moments, "moments", 8)
    return embedding.pca_embedding(moments, model, "moments").select("aoi", "row", "col", "embedding")


@query(
    "patch_moment_vector",
    compose(
        [*NORMAL],
        "SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, "
        + ", ".join(
            f"avg(coalesce({c}, 0)) AS {c}_mean, stddev_pop(coalesce({c}, 0)) AS {c}_std, "
            f"min(coalesce({c}, 0)) AS {c}_min, max(coalesce({c}, 0)) AS {c}_max"
            for c in BASE
        )
        + " FROM pp GROUP BY aoi, r0, c0",
        "aoi, row, col",
        ", ".join(f"{c}_{k}" for c in BASE for k in ("mean", "std", "min", "max")),
    ),
)
def patch_moment_vector(spark, sf):
    rows = embedding.patch_moment_vector(_normal_patches(spark, sf), BASE, "v")
    names = [f"{c}_{k}" for c in BASE for k in ("mean", "std", "min", "max")]
    return rounded(
        rows.select("aoi", "row", "col", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])
    )


@query("recon_pca")
def recon_pca(spark, sf):
    """Linear autoencoder over whole patches: channel means of the rebuilt pixels' errors."""
    cut = _normal_patches(spark, sf)
    model = autoencoder.fit_autoencoder(cut, BASE)
    scored = autoencoder.autoencoder_scores(cut, model, BASE, with_pixels=True)
    cells = scored.withColumn("cell", F.arrays_zip("pixel_mse", "pixel_uncertainty"))
    rows = cells.select("aoi", "row", "col", "mse", "uncertainty", F.posexplode("cell").alias("pos", "cell"))
    return rows.select(
        "aoi", "row", "col", "mse", "uncertainty",
        F.floor(F.col("pos") / F.lit(float(P))).cast("int").alias("pr"),
        (F.col("pos") % P).cast("int").alias("pc"), "cell.pixel_mse", "cell.pixel_uncertainty",
    )


SPREAD = (
    "sm AS (SELECT pr, pc, " + ", ".join(f"avg(coalesce({c}, 0)) AS s_{c}" for c in BASE)
    + " FROM pp GROUP BY pr, pc), sq AS (SELECT count(*) / 256 AS patches, "
    + "sum(" + " + ".join(f"pow(coalesce({c}, 0) - s_{c}, 2)" for c in BASE)
    + ") AS total FROM pp JOIN sm USING (pr, pc))"
)


@query(
    "recon_pca_invariants",
    compose(
        [*NORMAL, SPREAD],
        "SELECT CAST(patches AS BIGINT) AS patches, total, total AS parts, CAST(0 AS BIGINT) AS askew, "
        "CAST(1 AS BIGINT) AS better FROM sq",
        "patches, askew, better", "total, parts",
    ),
)
def recon_pca_invariants(spark, sf):
    """The components are orthonormal, their energy and what is left over add up to all squared
    distances from the mean patch, and no single pixel explains more than the first."""
    cut = _normal_patches(spark, sf)
    m = autoencoder.fit_autoencoder(cut, BASE)
    left = autoencoder.autoencoder_scores(cut, m, BASE).agg(
        F.count(F.lit(1)).alias("patches"), F.sum(F.col("mse") * F.lit(float(len(m.mean)))).alias("left")
    )
    askew = int((np.abs(m.basis.T @ m.basis - np.eye(m.basis.shape[1])) > 1e-9).sum())
    better = int(m.energy[0] >= m.total / len(m.mean) and (np.diff(m.energy) <= 0).all())
    return rounded(
        left.select(
            "patches", F.lit(m.total).alias("total"),
            (F.col("left") + F.lit(float(m.energy.sum()))).alias("parts"),
            F.lit(askew).cast("long").alias("askew"), F.lit(better).cast("long").alias("better"),
        )
    )


@query("user_model_embedding")
def user_model_embedding(spark, sf):
    """The hook for a user's own batch model, here a fixed random projection."""

    def make():
        weights = np.random.default_rng(7).normal(size=(P * P, 4)).astype("float32")

        def predict(dtm: np.ndarray) -> np.ndarray:
            return dtm.astype("float32") @ weights

        return predict

    model = embedding.user_model(make, ("dtm",), (P * P,), batch_size=32)
    cut = pt.sanitize_patches(_normal_patches(spark, sf), BASE)
    return cut.select(
        "aoi", "row", "col", model(F.col("dtm").cast("array<float>")).alias("embedding")
    )


# ---- flagship --------------------------------------------------------------

FULL_MEANS = (
    "mp AS (SELECT pr, pc, " + ", ".join(f"avg({c}) AS m_{c}" for c in CHANNELS) + " FROM pp GROUP BY pr, pc)"
)
FULL = [
    PX, AROUND, unpivot_sql("ter", CHANNELS), stats_sql("lng"),
    normalized_sql("ter", CHANNELS), cut_sql("nm"), FULL_MEANS, _mse_sql(CHANNELS),
]
PIXEL_META = """pm AS (SELECT aoi, min(row) AS zero, max(row) + 16 AS height, max(col) + 16 AS width,
  -55.0 + CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) * 0.01 AS min_lon,
  -3.4 + CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) * 0.01 AS min_lat,
  -54.99 + CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) * 0.01 AS max_lon,
  -3.391 + CAST(regexp_extract(aoi, 'AOI_(\\d+)', 1) AS INT) * 0.01 AS max_lat
  FROM er GROUP BY aoi)"""


@query(
    "top_candidates",
    compose(
        [*FULL, PIXEL_META,
         "sc AS (SELECT *, 1 / (1 + exp(-10 * mse)) AS score FROM er JOIN pm USING (aoi))",
         "rk AS (SELECT *, row_number() OVER (PARTITION BY aoi ORDER BY row, col) - 1 AS ordinal FROM sc)"],
        "SELECT printf('%s_p%03d', aoi, ordinal) AS patch_id, row + 8 AS center_row, col + 8 AS center_col, "
        "mse, score, max_lat - (row + 8) / CAST(height AS DOUBLE) * (max_lat - min_lat) AS lat, "
        "min_lon + (col + 8) / CAST(width AS DOUBLE) * (max_lon - min_lon) AS lng "
        "FROM rk WHERE score >= 0.5 ORDER BY mse DESC, patch_id LIMIT 20",
        "patch_id, center_row, center_col", "mse, score, lat, lng",
    ),
)
def top_candidates(spark, sf):
    """Raw bands to the twenty best located candidates, all seven channels."""
    normal, _ = scoring.prepare_pixels(tb.pixels(spark, sf))
    scored = scoring.scored_patches(normal, GRID, tb.MIN_VALID)
    meta = mosaic.area_extent(scored, P)
    i = F.regexp_extract("aoi", r"AOI_(\d+)", 1).cast("int") * 0.01
    best = scored.where("score >= 0.5").orderBy(F.desc("mse"), "patch_id").limit(20)
    placed = best.join(meta, "aoi").withColumns({"r": F.col("row") + 8, "c": F.col("col") + 8})
    return rounded(
        placed.select(
            "patch_id",
            F.col("r").alias("center_row"),
            F.col("c").alias("center_col"),
            "mse",
            "score",
            interpolate_lat(F.col("r"), F.col("height"), i - 3.4, i - 3.391).alias("lat"),
            interpolate_lon(F.col("c"), F.col("width"), i - 55.0, i - 54.99).alias("lng"),
        )
    )


# ---- mosaics ---------------------------------------------------------------


@query(
    "aoi_extent",
    compose([SC, EXTENT], "SELECT * FROM extent", "aoi, height, width"),
)
def aoi_extent(spark, sf):
    return mosaic.area_extent(tb.scores_only(spark, sf), 64)


HEAT = """cells AS (SELECT aoi, r.r AS row, c.c AS col FROM extent,
  (SELECT unnest(generate_series(0, 2047)) AS r) r, (SELECT unnest(generate_series(0, 2047)) AS c) c
  WHERE r.r < height AND c.c < width),
heat AS (SELECT cells.aoi, cells.row, cells.col, coalesce(avg(gate_prediction), 0) AS gate_prediction
  FROM cells LEFT JOIN sc ON sc.aoi = cells.aoi AND cells.row >= sc.row AND cells.row < sc.row + 64
  AND cells.col >= sc.col AND cells.col < sc.col + 64 GROUP BY cells.aoi, cells.row, cells.col)"""


@query(
    "heatmap_mean",
    compose([SC, EXTENT, HEAT],
            "SELECT aoi, CAST(row AS INT) AS row, CAST(col AS INT) AS col, gate_prediction FROM heat",
            "aoi, row, col", "gate_prediction"),
)
def heatmap_mean(spark, sf):
    return mosaic.heatmap_mean(tb.scores_only(spark, sf), tb.SCORE_GRID, "gate_prediction", 6)


@query(
    "positive_area",
    compose([SC, EXTENT, HEAT],
            "SELECT aoi, avg(CASE WHEN gate_prediction >= 0.5 THEN 1.0 ELSE 0.0 END) * 100 AS positive_pct "
            "FROM heat GROUP BY aoi", "aoi", "positive_pct"),
)
def positive_area(spark, sf):
    blocks = mosaic.heatmap_blocks(tb.scores_only(spark, sf), tb.SCORE_GRID, "gate_prediction")
    return rounded(mosaic.positive_area(blocks, "gate_prediction"))


BLEND = f"""bl AS (SELECT aoi, row, col, {SQUARED} AS e, greatest(least(1 - pow(sqrt(
  pow(pr - 8, 2) + pow(pc - 8, 2)) / (sqrt(2.0) * 8), 2), 1.0), 0.1) AS w FROM pp JOIN mp USING (pr, pc)),
mo AS (SELECT aoi, row, col, sum(w) AS weight, sum(e * w) / sum(w) AS squared_error
       FROM bl GROUP BY aoi, row, col)"""


def _mosaic(spark, sf, weighted=True):
    normal, template = _normal_pixels(spark, sf)
    return mosaic.blended_errors(normal, GRID, template, tb.MIN_VALID, BASE, weighted)


@query(
    "mosaic_weighted",
    compose([*NORMAL, MEANS, BLEND], "SELECT * FROM mo", "aoi, row, col", "weight, squared_error", places=8),
)
def mosaic_weighted(spark, sf):
    """Errors over all channels, blended by the distance from the patches' centres."""
    return rounded(_mosaic(spark, sf), 8)


@query(
    "mosaic_coverage",
    compose([*NORMAL, MEANS, BLEND,
             "ex AS (SELECT aoi, (max(r0) + 16) * (max(c0) + 16) AS area FROM ok GROUP BY aoi)"],
            "SELECT aoi, count(*) AS covered, count(*) / any_value(CAST(area AS DOUBLE)) * 100 AS coverage_pct, "
            "avg(weight) AS mean_overlap FROM mo JOIN ex USING (aoi) GROUP BY aoi",
            "aoi, covered", "coverage_pct, mean_overlap", places=9),
)
def mosaic_coverage(spark, sf):
    whole = settle(_mosaic(spark, sf), "mosaic")
    # The covered pixel furthest down and right ends the area's extent.
    extent = whole.groupBy("aoi").agg(
        (F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width")
    )
    return rounded(mosaic.mosaic_coverage(whole, extent), 9)


@query(
    "pixel_heatmap",
    compose([*NORMAL, MEANS],
            f"SELECT aoi, row, col, avg({SQUARED}) AS squared_error "
            "FROM pp JOIN mp USING (pr, pc) GROUP BY aoi, row, col", "aoi, row, col", "squared_error"),
)
def pixel_heatmap(spark, sf):
    """Overlap mean of a score that differs from pixel to pixel."""
    return rounded(_mosaic(spark, sf, False).drop("weight"))
