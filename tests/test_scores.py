import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsieve.functions import scalars as fx
from gridsieve.operators import evaluation as ev
from gridsieve.operators import results as rs
from gridsieve.operators import similarity as sim
from gridsieve.operators.models import forest, gate
from gridsieve.sources import readers


def _scores(spark, values):
    rows = [("A", f"A_p{i:03d}", 0, 32 * i, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "aoi string, patch_id string, row int, col int, gate_prediction double")


def test_threshold_equality_counts_but_does_not_flag(spark):
    r = rs.flag_against_threshold(_scores(spark, [0.5]), 0.5).first()
    assert r["detected"] and not r["is_anomaly"]


def test_ties_keep_id_order_and_short_lists(spark):
    top = rs.top_candidates(_scores(spark, [0.4, 0.9, 0.9]), 2).collect()
    assert [r["patch_id"] for r in top] == ["A_p001", "A_p002"]
    assert rs.top_positive(_scores(spark, [0.1]), 0.5).count() == 0


def test_empty_summary_is_null(spark):
    r = rs.prediction_summary(_scores(spark, [0.1]).where("false")).first()
    assert r["total_patches"] == 0 and r["anomaly_percentage"] is None


def test_reconstruction_score_is_at_least_half(spark):
    r = spark.range(5).select(fx.reconstruction_score(F.col("id") / 10.0).alias("s")).agg(F.min("s")).first()
    assert r[0] == 0.5


def test_golden_confusion(spark):
    rows = [(0, 0.1)] * 15 + [(1, 0.2)] * 2 + [(1, 0.9)] * 5
    df = spark.createDataFrame(rows, "y int, p double")
    cells = {(r["actual"], r["predicted"]): r["patches"] for r in ev.confusion_matrix(df, "y", "p").collect()}
    assert cells == {(0, 0): 15, (0, 1): 0, (1, 0): 2, (1, 1): 5}
    m = ev.classification_metrics(df, "y", "p").first()
    assert (m["accuracy"], m["precision"]) == (pytest.approx(20 / 22), 1.0)
    assert (m["recall"], m["f1"]) == (pytest.approx(5 / 7), pytest.approx(5 / 6))


def _vectors(spark, n, seed, name="id"):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{name} long, embedding array<double>")


@pytest.mark.parametrize("metric", ["cosine", "euclidean"])
def test_blocks_and_broadcast_agree_with_brute_force(spark, metric):
    p, s = _vectors(spark, 57, 1), _vectors(spark, 23, 2, "site_idx")
    x = np.array([r["embedding"] for r in p.orderBy("id").collect()])
    y = np.array([r["embedding"] for r in s.orderBy("site_idx").collect()])
    if metric == "cosine":
        m = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T
        idx, best = m.argmax(1), m.max(1)
    else:
        m = np.linalg.norm(x[:, None] - y[None], axis=2)
        idx, best = m.argmin(1), m.min(1)
    for kw in ({}, {"max_broadcast_bytes": 0, "block_rows": 5}):
        got = sim.best_match(p, s, "id", metric=metric, **kw).orderBy("id").collect()
        assert [r["best_idx"] for r in got] == list(idx)
        np.testing.assert_allclose([r["best"] for r in got], best, atol=1e-8)


def test_top_matches_in_parts(spark):
    p, s = _vectors(spark, 11, 1), _vectors(spark, 23, 2, "site_idx")
    a = sorted(map(tuple, sim.top_matches(p, s, "id", 3).collect()))
    b = sorted(map(tuple, sim.top_matches(p, s, "id", 3, max_broadcast_bytes=0, block_rows=6).collect()))
    assert [t[:3] for t in a] == [t[:3] for t in b] and len(a) == 33


def test_ties_take_the_lowest_site_and_no_sites_score_zero(spark):
    p = spark.createDataFrame([(0, [1.0, 0.0])], "id long, embedding array<double>")
    s = spark.createDataFrame([(4, [2.0, 0.0]), (2, [3.0, 0.0])], "site_idx long, embedding array<double>")
    for kw in ({}, {"max_broadcast_bytes": 0, "block_rows": 1}):
        assert sim.best_match(p, s, "id", eps=0.0, **kw).first()["best_idx"] == 2
    assert sim.site_similarity(p, s.where("false"), "id", "online").first()["arch_similarity"] == 0.0


def test_forest_isolates_an_outlier(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(300)] + [(300, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    grown = forest.grow_forest(df, "id", "v", trees=30, sample=64)
    again = forest.grow_forest(df.repartition(5), "id", "v", trees=30, sample=64)
    assert sorted(map(tuple, grown.collect())) == sorted(map(tuple, again.collect()))
    scored = forest.raw_scores(df, grown, "v")
    assert scored.orderBy("score").first()["id"] == 300
    assert scored.where("score >= 0 or score < -1").count() == 0
    done = forest.decide(scored, forest.forest_offset(df, grown, "v", 0.05))
    assert 14 <= done.where("flag = -1").count() <= 16


def test_average_path_length():
    np.testing.assert_allclose(forest.average_path([1, 2, 3]), [0.0, 1.0, 2 * (math.log(2) + np.euler_gamma) - 4 / 3])


def test_gate_network_matches_matrix_product(spark):
    m = gate.demo_weights()
    x = np.array([[0.1, 0.9, 0.4, 0.7], [0.5, 0.5, 0.5, 0.5]])
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in gate.FEATURES))
    h = (x - m["mean"]) / m["scale"]
    for n, (w, b) in enumerate(zip(m["weights"], m["biases"])):
        h = h @ np.array(w).T + b
        h = 1 / (1 + np.exp(-h)) if n == 2 else np.maximum(h, 0)
    got = [r["gate_prediction"] for r in gate.gate_score(df, m).collect()]
    np.testing.assert_allclose(sorted(got), sorted(h.ravel()), atol=1e-12)


def test_coordinates_parse_and_missing_keys(spark):
    lines = spark.createDataFrame(
        [("f1", "AOI_ID: AOI_0007"), ("f1", "LiDAR_File: tile.laz"), ("f1", "min_lon: -55.5"), ("f2", "AOI_ID: AOI_0008"), ("f2", "noise")],
        "file string, line string",
    )
    got = {r["aoi"]: (r["lidar_file"], r["min_lon"], r["max_lat"]) for r in readers.parse_coordinates(lines).collect()}
    assert got == {"AOI_0007": ("tile.tif", -55.5, None), "AOI_0008": (None, None, None)}


def test_required_input_file(spark):
    files = spark.createDataFrame([("B04.tif", 0)], "name string, ordinal int")
    assert readers.pick_input_file(files, "ndwi").first()["name"] is None
    with pytest.raises(Exception, match="no ndvi file"):
        readers.pick_input_file(files, "ndvi", required=True).collect()


def test_first_document_wins(spark, tmp_path):
    import json

    doc = {"summary": {"total_aois": 1}, "aois": [{"aoi_id": "A"}], "top_candidates": [{"patch_id": "p"}], "all_anomalies": [{"patch_id": "p"}, {"patch_id": "q"}]}
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc))
    parts = readers.read_document_file(spark, [str(tmp_path / "absent.json"), str(path)])
    assert parts["all_anomalies"].count() == 2 and parts["summary"].first()["total_aois"] == 1
    with pytest.raises(FileNotFoundError):
        readers.read_document_file(spark, [str(tmp_path / "absent.json")])


def test_band_files_name_the_areas(spark, tmp_path):
    for name in ("AOI_0003/sentinel/NDVI.tif", "AOI_0005/sentinel/ndwi.tif"):
        f = tmp_path / name
        f.parent.mkdir(parents=True)
        f.write_bytes(b"x")
    files = readers.list_files(spark, str(tmp_path), "*.tif")
    assert [tuple(r) for r in readers.areas_in_paths(files).collect()] == [("AOI_0003", 3)]


def test_model_store_keeps_parts_and_reads_bare_tables(spark, tmp_path):
    from gridsieve.sources import models

    nodes = spark.range(5)
    models.save_model(str(tmp_path / "full"), nodes, scaler=spark.range(2))
    full = models.load_model(spark, str(tmp_path / "full"))
    assert (full["model"].count(), full["scaler"].count(), full["offset"]) == (5, 2, None)
    nodes.write.parquet(str(tmp_path / "bare"))
    bare = models.load_model(spark, str(tmp_path / "bare"))
    assert bare["model"].count() == 5 and bare["scaler"] is None


def test_classifier_survives_storage(spark, tmp_path):
    from gridsieve.sources import models

    rows = [(i / 40, 1 - i / 40, 0.5, 0.2, int(i > 20)) for i in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in gate.FEATURES) + ", label int")
    model = gate.fit_gate(df, kind="logistic")
    models.save_classifier(model, str(tmp_path / "gate"))
    back = models.load_classifier(str(tmp_path / "gate"))
    a = gate.apply_gate(model, df).orderBy("prob_autoencoder").collect()
    assert a == gate.apply_gate(back, df).orderBy("prob_autoencoder").collect()


def test_matches_of_repeated_keys_and_missing_vectors(spark):
    sites = spark.createDataFrame(
        [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0])], "site_idx long, embedding array<double>"
    )
    rows = [(0, [1.0, 0.1, 0.0]), (0, [0.0, 2.0, 0.0]), (1, None), (2, [0.1, 1.0, 0.0])]
    p = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    want = [(0, 0), (0, 1), (1, None), (2, 1)]
    for kw in ({}, {"max_broadcast_bytes": 0, "block_rows": 1}):
        m = sim.best_match(p, sites, "id", **kw).select("id", "best_idx").collect()
        assert sorted(map(tuple, m), key=str) == sorted(want, key=str)
        top = sim.top_matches(p, sites, "id", 1, **kw).select("id", "site_idx").collect()
        assert sorted(map(tuple, top)) == [(0, 0), (0, 1), (2, 1)]


def test_vectors_of_other_lengths_are_refused():
    import pyarrow as pa

    with pytest.raises(ValueError):
        sim.rows_as_matrix(pa.array([[1.0, 2.0], [1.0]]))
    with pytest.raises(ValueError):
        sim.rows_as_matrix(pa.array([[1.0, 2.0]]), 3)
    assert np.isnan(sim.rows_as_matrix(pa.array([None, [1.0, 2.0]]))[0]).all()
    assert sim.rows_as_matrix(pa.array([None], pa.list_(pa.float64())), 3).shape == (1, 3)


def test_late_arrivals_are_kept(spark, tmp_path):
    from gridsieve.streaming import scoring as st

    schema = "patch_id string, ts timestamp"
    for i, hour in enumerate((12, 0, 6)):
        spark.sql(
            f"SELECT concat('p', id) AS patch_id, timestamp'2024-01-01 {hour:02d}:10:00' AS ts "
            f"FROM range({4 * i}, {4 * i + 6})"
        ).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    read = lambda: st.read_stream(spark, f"{tmp_path}/in/*", schema, files_per_batch=1)
    st.run_available(st.first_arrivals(read()), f"{tmp_path}/once", f"{tmp_path}/c1")
    assert spark.read.parquet(f"{tmp_path}/once").count() == 14
    counted = st.window_counts(read(), "ts", [], "1 hour")
    st.run_upserts(counted, f"{tmp_path}/counts", f"{tmp_path}/c2")
    back = st.latest_rows(spark, f"{tmp_path}/counts", counted.schema, ["window_start"])
    assert [r["n"] for r in back.orderBy("window_start").collect()] == [6, 6, 6]
