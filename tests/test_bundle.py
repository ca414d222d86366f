"""All models in one pass against the models one by one; fits against NumPy."""

import numpy as np
import pytest

from conftest import raster
from gridsieve.config import PatchGrid
from gridsieve.operators import patches as pt
from gridsieve.operators import similarity as sim
from gridsieve.operators.models import autoencoder, bundle, clusters, forest, gate
from gridsieve.sources.models import load_bundle, save_bundle

GRID = PatchGrid(8, 4)
CH = ("ndvi", "dtm")


@pytest.fixture(scope="module")
def normal(spark):
    rng = np.random.default_rng(3)
    out = None
    for aoi, (h, w) in {"A": (40, 32), "B": (20, 24)}.items():
        x, y = rng.normal(size=(h, w)), rng.normal(size=(h, w))
        x[3, 4], y[7:9, 2] = np.nan, np.nan
        one = raster(spark, aoi, ndvi=x, dtm=y)
        out = one if out is None else out.unionByName(one)
    return out.cache()


@pytest.fixture(scope="module")
def fitted(spark, normal):
    sites = np.random.default_rng(5).normal(size=(9, 8))
    return bundle.fit_bundle(
        normal, GRID, sites, gate.demo_weights(), 0.7, CH, clusters=3, restarts=3
    )


@pytest.mark.parametrize("variant", ["online", "offline"])
def test_fused_scores_equal_the_models_one_by_one(spark, normal, fitted, variant):
    got = bundle.fused_scores(normal, GRID, fitted, variant, 0.7, CH, with_embedding=True)
    got = got.orderBy("aoi", "row", "col").toPandas()
    cut = pt.extract_patches(normal, GRID, 0.7, CH).orderBy("aoi", "row", "col").toPandas()
    assert len(got) == len(cut) > 50
    x = np.stack([np.stack(cut[c].map(lambda v: np.array(v, float))) for c in CH], axis=1)
    clean = np.nan_to_num(x)
    want = np.stack([clean.mean(2), clean.std(2), clean.min(2), clean.max(2)], axis=2)
    vectors = want.reshape(len(x), -1)
    np.testing.assert_allclose(np.stack(got["embedding"]), vectors, atol=1e-12)
    z = (vectors - fitted.mean) / fitted.scale
    decision = forest.walk_forest(z, fitted.forest) - fitted.offset
    np.testing.assert_allclose(got["decision"], decision, atol=1e-12)
    mse = np.nanmean((x - fitted.template) ** 2, axis=(1, 2))
    np.testing.assert_allclose(got["mse"], mse, atol=1e-12)
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    like = unit(vectors) @ unit(fitted.sites).T
    if variant == "online":
        far = np.linalg.norm(z[:, None] - fitted.centres[None], axis=2)
        km = 1 - far.min(axis=1) / fitted.spread
        ae, fo, known = 1 / (1 + np.exp(-10 * mse)), 1 / (1 + np.exp(-decision)), like.max(axis=1)
    else:
        km = ((unit(z) @ unit(fitted.centres).T).max(axis=1) + 1) / 2
        scale = lambda v: np.concatenate(
            [(p - p.min()) / (np.ptp(p) + 1e-10) for p in (v[got["aoi"] == a] for a in "AB")]
        )
        ae, fo, known = scale(mse), scale(-decision), (like.max(axis=1) + 1) / 2
    for name, v in zip(gate.FEATURES, (ae, fo, km, known)):
        np.testing.assert_allclose(got[name], v, atol=1e-7)
    p = gate.forward(np.stack([ae, fo, km, known], axis=1), gate.demo_weights())
    np.testing.assert_allclose(got["gate_prediction"], p, atol=1e-7)


def test_bundle_store(spark, normal, fitted, tmp_path):
    save_bundle(spark, fitted, str(tmp_path / "b"))
    back = load_bundle(spark, str(tmp_path / "b"))
    a, b = (
        bundle.fused_scores(normal, GRID, m, "online", 0.7, CH).orderBy("aoi", "row", "col").collect()
        for m in (fitted, back)
    )
    assert a == b and fitted.members.sum() == len(a)
    assert fitted.offset == back.offset and back.forest["feature"].dtype == np.int64


def test_bundle_without_sites_scores_zero(spark, normal, fitted):
    fitted_sites, fitted.sites = fitted.sites, np.zeros((0, 8))
    try:
        got = bundle.fused_scores(normal, GRID, fitted, "online", 0.7, CH).first()
    finally:
        fitted.sites = fitted_sites
    assert got["arch_similarity"] == 0.0 and got["best_idx"] == -1


def test_too_many_sites_raise(spark, monkeypatch):
    monkeypatch.setattr(bundle, "MAX_SITE_BYTES", 8)
    sites = spark.createDataFrame([(0, [1.0, 2.0])], "site_idx long, embedding array<double>")
    with pytest.raises(ValueError, match="too many"):
        bundle.site_matrix(sites)


def test_kmeans_settles_on_means_of_members(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(c, 0.2, size=(n, 3)) for c, n in ((0, 300), (4, 90), (-5, 10))])
    rows = [(i, [float(v) for v in p]) for i, p in enumerate(x)] + [(999, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(5)
    fit = clusters.fit_kmeans(df, "id", "v", k=3, restarts=4)
    gap = np.linalg.norm(x[:, None] - fit.centres[None], axis=2)
    at = gap.argmin(axis=1)
    assert sorted(fit.members.tolist()) == [10, 90, 300] == sorted(np.bincount(at).tolist())
    for k in range(3):
        np.testing.assert_allclose(fit.centres[k], x[at == k].mean(axis=0), atol=1e-9)
    np.testing.assert_allclose(fit.cost, (gap.min(axis=1) ** 2).sum(), rtol=1e-9)
    again = clusters.fit_kmeans(df.repartition(2), "id", "v", k=3, restarts=4)
    np.testing.assert_allclose(np.sort(again.centres, 0), np.sort(fit.centres, 0), atol=1e-9)
    assert fit.passes <= 300


def test_kmeans_with_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id long, v array<double>")
    fit = clusters.fit_kmeans(df, "id", "v", k=3, restarts=2)
    assert fit.cost == pytest.approx(0.0) and fit.members.sum() == 2
    assert clusters.fit_kmeans(df.where("id > 5"), "id", "v", k=3).members.sum() == 0


def test_scaler_arrays(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],), (None,)], "v array<double>")
    mean, scale = clusters.scaler_arrays(df, "v")
    assert mean.tolist() == [2.0, 5.0] and scale.tolist() == [1.0, 1.0]


def test_autoencoder_equals_the_singular_values(spark, normal):
    cut = pt.extract_patches(normal, GRID, 0.7, CH).cache()
    model = autoencoder.fit_autoencoder(cut, CH, components=4, power=25)
    rows = cut.orderBy("aoi", "row", "col").toPandas()
    x = np.concatenate([np.nan_to_num(np.stack(rows[c].map(lambda v: np.array(v, float)))) for c in CH], axis=1)
    u, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(model.basis.T @ model.basis, np.eye(4), atol=1e-9)
    np.testing.assert_allclose(model.energy, s[:4] ** 2, rtol=1e-5)
    np.testing.assert_allclose(model.total, (s**2).sum(), rtol=1e-9)
    got = autoencoder.autoencoder_scores(cut, model, CH, with_pixels=True)
    got = got.orderBy("aoi", "row", "col").toPandas()
    out = model.rebuild(x)
    np.testing.assert_allclose(got["mse"], ((x - out) ** 2).mean(axis=1), atol=1e-9)
    np.testing.assert_allclose(got["uncertainty"], (1 - 2 * np.abs(out - 0.5)).mean(axis=1), atol=1e-9)
    pixel = ((x - out) ** 2).reshape(len(x), 2, -1).mean(axis=1)
    np.testing.assert_allclose(np.stack(got["pixel_mse"]), pixel, atol=1e-9)
    codes = autoencoder.autoencoder_codes(cut, model, CH).select("embedding").first()[0]
    assert len(codes) == 4
    assert autoencoder.fit_autoencoder(cut.where("row < 0"), CH) is None


def test_walking_sites_is_exact_and_does_not_move_patches(spark):
    rng = np.random.default_rng(11)
    # Sites in bundles of directions, so that bounds skip chunks; ties and odd vectors too.
    base = rng.normal(size=(12, 6))
    s = np.concatenate([b + rng.normal(0, 0.05, size=(25, 6)) for b in base])
    s[40] = s[7]
    p = np.concatenate((base + 0.01, rng.normal(size=(50, 6)), s[:8]))
    rows = [(i % 60, [float(v) for v in r]) for i, r in enumerate(p)]
    rows += [(100, None), (101, [float("nan")] * 6)]
    patches = spark.createDataFrame(rows, "id long, embedding array<double>").repartition(3)
    sites = spark.createDataFrame(
        [(i, [float(v) for v in r]) for i, r in enumerate(s)], "site_idx long, embedding array<double>"
    )
    for metric in ("cosine", "euclidean"):
        whole = sim.best_match(patches, sites, "id", metric=metric).collect()
        walked = sim.best_match(
            patches, sites, "id", metric=metric, max_broadcast_bytes=3 * 10 * 6 * 8, block_rows=10
        )
        key = lambda r: (r["id"], r["best_idx"] if r["best_idx"] is not None else -1)
        got = sorted(walked.collect(), key=key)
        want = sorted(whole, key=key)
        assert [key(r) for r in got] == [key(r) for r in want]
        for a, b in zip(got, want):
            assert a["best"] is b["best"] is None or a["best"] == pytest.approx(b["best"], abs=1e-9)
        plan = walked._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
