"""Registered queries against their SQL on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry_points

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# One or more queries of every family; the whole register runs outside pytest.
NAMES = [
    "discover_aois", "assemble_channels", "resample_bilinear", "dtm_aoi_stats", "median_fill",
    "stats_sample", "global_stats", "normalize_channels", "slope", "local_relief",
    "percentile_stretch", "extract_patches", "mean_pool", "patch_ids", "recon_mean_mse",
    "template_match", "top_candidates", "positive_area", "mosaic_weighted", "minmax_eps",
    "minmax_guarded", "pixel_to_latlon", "extract_anomalies", "top20_per_aoi",
    "aoi_prediction_summary", "aoi_rollup", "score_histogram", "score_percentiles",
    "eval_confusion", "dq_rules", "csv_report_roundtrip", "demo_document", "run_log_roundtrip",
    "temporal_change", "spatial_context", "gate_mlp_score", "split_stratified", "arch_similarity",
    "arch_similarity_blocks", "explain_patch", "kmeans_distance", "coords_parse",
    "polygon_bounds", "stream_scores", "stream_dedup", "stream_window_counts",
    "areas_from_patch_files", "band_inventory", "resample_rotated", "template_field", "hillshade",
    "site_dimensions",
]


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _canon(rows, names, order):
    at = [names.index(c) for c in order]
    clean = lambda v: float(v) if type(v).__name__ == "Decimal" else v
    return sorted((tuple(str(clean(r[i])) for i in at) for r in rows))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = entry_points.queries()[name](spark, sf_dir)
    cur = duck.execute(entry_points.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    order = sorted(df.columns)
    assert sorted(names) == order
    want = _canon(cur.fetchall(), names, order)
    assert want, "a comparison without rows shows nothing"
    assert _canon(df.collect(), df.columns, order) == want


def test_register_is_consistent():
    queries, sql = entry_points.queries(), entry_points.oracle_sql()
    assert set(sql) <= set(queries) and set(NAMES) <= set(sql)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
