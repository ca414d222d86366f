"""Pixels to all five scores and ranked GATE candidates, by fixed and by fitted models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..config import CHANNELS
from ..functions.scalars import interpolate_lat, interpolate_lon
from ..operators import mosaic
from ..operators import patches as pt
from ..operators import similarity as sim
from ..operators.models import bundle as bd
from ..operators.models import embedding, forest
from ..operators.models.gate import demo_weights
from ..session import scratch_path, settle
from ..sources.models import load_bundle, save_bundle
from . import scoring
from . import tables as tb
from .model_queries import SITES, _cos
from .patch_queries import FULL, PIXEL_META
from .registry import SC, compose, gate_ctes, query, rounded

GRID = tb.PIXEL_GRID
WIDTH = 4 * len(CHANNELS)
OFFSET = -0.5

# ---- fixed models: a scaler, five small trees, and weights of a network -----


def fixed_scaler() -> tuple[list[float], list[float]]:
    mean = [round(0.3 * math.sin(1.0 + i), 3) for i in range(WIDTH)]
    return mean, [round(0.6 + 0.02 * i, 3) for i in range(WIDTH)]


def fixed_trees() -> list[tuple]:
    """Each tree isolates 2 of 16 points at depth 1, and 5 and 9 at depth 2."""
    rows = []
    for t in range(5):
        high, low = round(0.4 - 0.2 * t, 2), round(0.15 * t - 0.3, 2)
        rows += [
            (t, 0, 5 * t % WIDTH, high, 1, 2, 0, 16), (t, 1, -1, 0.0, -1, -1, 1, 2),
            (t, 2, (7 * t + 3) % WIDTH, low, 3, 4, 1, 14), (t, 3, -1, 0.0, -1, -1, 2, 5),
            (t, 4, -1, 0.0, -1, -1, 2, 9),
        ]
    return rows


def fixed_bundle(spark, sf, template: np.ndarray) -> bd.ModelBundle:
    """Fixed models, with sites and centres from the table of vectors."""
    mean, scale = fixed_scaler()
    short = F.slice(F.col("embedding").cast("array<double>"), 1, WIDTH).alias("embedding")
    centres = tb.centroids(spark, sf).orderBy("cluster").select(short).toArrow()
    return bd.ModelBundle(
        template, np.array(mean), np.array(scale),
        forest.pack_forest(spark.createDataFrame(fixed_trees(), forest.NODE_SCHEMA)), OFFSET,
        sim.rows_as_matrix(centres.column("embedding")),
        bd.site_matrix(tb.reference_sites(spark, sf).select("site_idx", short)), demo_weights(),
    )


def _prepared(spark, sf):
    """Normalised pixels, and the fixed bundle after a round trip through its store."""
    normal, _ = scoring.prepare_pixels(tb.pixels(spark, sf))
    mean = embedding.mean_patch_of_pixels(normal, GRID, tb.MIN_VALID)
    made = fixed_bundle(spark, sf, embedding._shared_template(mean, CHANNELS).value)
    path = scratch_path(spark, "bundle")
    save_bundle(spark, made, path)
    return normal, load_bundle(spark, path)


# ---- the same in SQL --------------------------------------------------------


def _moments_sql() -> str:
    cells = []
    for c in CHANNELS:
        v = f"coalesce({c}, 0)"
        cells += [f"avg({v})", f"stddev_pop({v})", f"CAST(min({v}) AS DOUBLE)", f"CAST(max({v}) AS DOUBLE)"]
    return (
        "emb AS (SELECT aoi, CAST(r0 AS INT) AS row, CAST(c0 AS INT) AS col, "
        f"[{', '.join(cells)}] AS e FROM pp GROUP BY aoi, r0, c0)"
    )


def _scaled_sql() -> str:
    mean, scale = fixed_scaler()
    cells = ", ".join(f"(e[{i + 1}] - ({m})) / {s}" for i, (m, s) in enumerate(zip(mean, scale)))
    return f"sv AS (SELECT *, [{cells}] AS z FROM emb)"


def _forest_sql() -> str:
    """Depth of every tree as a CASE, then the decision."""
    depth = lambda d, n: d + float(forest.average_path(n))
    nodes = {(t[0], t[1]): t for t in fixed_trees()}
    total = []
    for t in range(5):
        root, inner = nodes[t, 0], nodes[t, 2]
        total.append(
            f"CASE WHEN z[{root[2] + 1}] <= {root[3]} THEN {depth(1, 2)} "
            f"WHEN z[{inner[2] + 1}] <= {inner[3]} THEN {depth(2, 5)} ELSE {depth(2, 9)} END"
        )
    mean = f"({' + '.join(total)}) / 5"
    return (
        f"fo AS (SELECT *, -pow(2, -({mean}) / {float(forest.average_path(16))}) - ({OFFSET}) "
        "AS decision FROM sv)"
    )


CENTRES = f"""cell AS (SELECT label AS cluster, unnest(embedding) AS x,
  unnest(generate_series(1, len(embedding))) AS pos FROM embeddings),
cent AS (SELECT cluster, list(m ORDER BY pos) AS c FROM
  (SELECT cluster, pos, avg(CAST(x AS DOUBLE)) AS m FROM cell WHERE pos <= {WIDTH}
   GROUP BY cluster, pos) GROUP BY cluster)"""
SHORT = f"ss AS (SELECT site_idx, CAST(embedding[1:{WIDTH}] AS DOUBLE[]) AS s FROM sites)"


def _models_sql(variant: str) -> list[str]:
    eps = "1e-8" if variant == "online" else "1e-10"
    like = (
        f"al AS (SELECT aoi, row, col, site_idx, {_cos('e', 's', eps)} AS sim FROM fo, ss)",
        "bs AS (SELECT aoi, row, col, max(sim) AS best, arg_max(site_idx, sim) AS best_idx FROM al "
        "GROUP BY aoi, row, col)",
    )
    if variant == "online":
        near = (
            "nc AS (SELECT aoi, row, col, cluster, list_distance(z, c) AS d FROM fo, cent)",
            "mx AS (SELECT max(list_distance(a.c, b.c)) AS m FROM cent a, cent b)",
            "ks AS (SELECT aoi, row, col, arg_min(cluster, d) AS cluster, "
            "1 - min(d) / any_value(m) AS prob_kmeans FROM nc, mx GROUP BY aoi, row, col)",
        )
        last = (
            "five AS (SELECT er.*, decision, cluster, best_idx, prob_kmeans, best AS arch_similarity, "
            "1 / (1 + exp(-10 * mse)) AS prob_autoencoder, 1 / (1 + exp(-decision)) AS prob_iforest "
            "FROM er JOIN fo USING (aoi, row, col) JOIN bs USING (aoi, row, col) "
            "JOIN ks USING (aoi, row, col))"
        )
    else:
        near = (
            f"nc AS (SELECT aoi, row, col, cluster, {_cos('z', 'c', '1e-10')} AS s FROM fo, cent)",
            "ks AS (SELECT aoi, row, col, arg_max(cluster, s) AS cluster, "
            "(max(s) + 1) / 2 AS prob_kmeans FROM nc GROUP BY aoi, row, col)",
        )
        last = (
            "five AS (SELECT er.*, decision, cluster, best_idx, prob_kmeans, "
            "(best + 1) / 2 AS arch_similarity, (mse - min(mse) OVER a) / "
            "(max(mse) OVER a - min(mse) OVER a + 1e-10) AS prob_autoencoder, "
            "(-decision - min(-decision) OVER a) / (max(-decision) OVER a - min(-decision) OVER a "
            "+ 1e-10) AS prob_iforest FROM er JOIN fo USING (aoi, row, col) "
            "JOIN bs USING (aoi, row, col) JOIN ks USING (aoi, row, col) "
            "WINDOW a AS (PARTITION BY aoi))"
        )
    return [
        *FULL, SC, SITES, _moments_sql(), _scaled_sql(), _forest_sql(), CENTRES, SHORT, *like,
        *near, last, *gate_ctes(demo_weights(), "five", "aoi, row, col"),
    ]


ALL = (
    "aoi, row, col, n_valid, cluster, best_idx",
    "decision, prob_autoencoder, prob_iforest, prob_kmeans, arch_similarity, gate_prediction",
)
FIVE = "SELECT five.*, gate AS gate_prediction FROM five JOIN gated USING (aoi, row, col)"


def _columns(df):
    return rounded(df.select(*[c.strip() for part in ALL for c in part.split(",")]))


@query("fused_offline", compose(_models_sql("offline"), FIVE, *ALL))
def fused_offline(spark, sf):
    """Five offline scores of every patch from the raw bands, in one pass over the blocks."""
    normal, models = _prepared(spark, sf)
    return _columns(bd.fused_scores(normal, GRID, models, "offline", tb.MIN_VALID))


@query("fused_online", compose(_models_sql("online"), FIVE, *ALL))
def fused_online(spark, sf):
    """Five online scores of every patch from the raw bands."""
    normal, models = _prepared(spark, sf)
    return _columns(bd.fused_scores(normal, GRID, models, "online", tb.MIN_VALID))


@query(
    "gate_candidates",
    compose(
        [*_models_sql("online"), PIXEL_META,
         "rk AS (SELECT five.*, gate, pm.*, row_number() OVER (PARTITION BY five.aoi ORDER BY "
         "five.row, five.col) - 1 AS ordinal FROM five JOIN gated USING (aoi, row, col) "
         "JOIN pm ON pm.aoi = five.aoi)"],
        "SELECT printf('%s_p%03d', aoi, ordinal) AS patch_id, row + 8 AS center_row, "
        "col + 8 AS center_col, gate AS gate_prediction, prob_autoencoder, prob_iforest, prob_kmeans, "
        "arch_similarity, max_lat - (row + 8) / CAST(height AS DOUBLE) * (max_lat - min_lat) AS lat, "
        "min_lon + (col + 8) / CAST(width AS DOUBLE) * (max_lon - min_lon) AS lng "
        "FROM rk WHERE gate >= 0.5 ORDER BY round(gate, 9) DESC, patch_id LIMIT 20",
        "patch_id, center_row, center_col",
        "gate_prediction, prob_autoencoder, prob_iforest, prob_kmeans, arch_similarity, lat, lng",
    ),
)
def gate_candidates(spark, sf):
    """Raw bands to the twenty best located candidates, ranked by the GATE score."""
    normal, models = _prepared(spark, sf)
    scored = settle(bd.fused_scores(normal, GRID, models, "online", tb.MIN_VALID), "scored")
    return rounded(located(pt.number_rows(scored), 20))


def located(scored, n: int):
    """The ``n`` best patches at or over 0.5, with the position of their centres."""
    meta = mosaic.area_extent(scored, GRID.patch)
    i = F.regexp_extract("aoi", r"AOI_(\d+)", 1).cast("int") * 0.01
    best = scored.where("gate_prediction >= 0.5").orderBy(
        F.desc(F.round("gate_prediction", 9)), "patch_id"
    )
    half = GRID.patch // 2
    placed = best.limit(n).join(meta, "aoi").withColumns(
        {"center_row": F.col("row") + half, "center_col": F.col("col") + half}
    )
    return placed.select(
        "patch_id", "center_row", "center_col", "gate_prediction", "prob_autoencoder",
        "prob_iforest", "prob_kmeans", "arch_similarity",
        interpolate_lat(F.col("center_row"), F.col("height"), i - 3.4, i - 3.391).alias("lat"),
        interpolate_lon(F.col("center_col"), F.col("width"), i - 55.0, i - 54.99).alias("lng"),
    )


@query(
    "fitted_bundle_invariants",
    compose(
        [*FULL],
        "SELECT count(*) AS patches, CAST(ceil(count(*) * 0.05) AS BIGINT) AS most_flagged, "
        "CAST(0 AS BIGINT) AS outside, CAST(100 AS BIGINT) AS trees, CAST(0 AS BIGINT) AS bad_splits, "
        "CAST(0 AS BIGINT) AS gap FROM er",
        "patches, most_flagged, outside, trees, bad_splits, gap",
    ),
)
def fitted_bundle_invariants(spark, sf):
    """Models fitted on the patches themselves: what must hold whatever the draws.

    ``most_flagged`` is the share of contamination if no more are flagged; ``outside`` counts
    offline scores outside 0 to 1, ``bad_splits`` forest nodes whose children do not hold all
    their points, ``gap`` is 1 if the clusters' members are not all patches.
    """
    normal, _ = scoring.prepare_pixels(tb.pixels(spark, sf))
    none = np.zeros((0, WIDTH))
    models = bd.fit_bundle(normal, GRID, none, demo_weights(), tb.MIN_VALID, restarts=2)
    models.sites = models.centres
    scored = settle(bd.fused_scores(normal, GRID, models, "offline", tb.MIN_VALID), "scored")
    five = ("prob_autoencoder", "prob_iforest", "prob_kmeans", "arch_similarity", "gate_prediction")
    inside = None
    for c in five:
        good = F.col(c).between(-1e-9, 1 + 1e-9)
        inside = good if inside is None else inside & good
    f = models.forest
    inner = np.flatnonzero(f["feature"] >= 0)
    bad = int((f["size"][inner] != f["size"][f["left"][inner]] + f["size"][f["right"][inner]]).sum())
    n = F.count(F.lit(1))
    most = F.ceil(n * 0.05)
    flagged = F.count_if(F.col("decision") < 0)
    return scored.agg(
        n.alias("patches"),
        F.when(flagged <= most, most).otherwise(flagged).cast("long").alias("most_flagged"),
        F.count_if(~F.coalesce(inside, F.lit(False))).alias("outside"),
        F.lit(len(f["roots"])).cast("long").alias("trees"),
        F.lit(bad).cast("long").alias("bad_splits"),
        F.when(n == int(models.members.sum()), 0).otherwise(1).cast("long").alias("gap"),
    )
