import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsieve.operators import similarity as sim


def _unit(rng, n, d=8):
    x = rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_scores_against_many_sites_stay_in_tiles():
    rng = np.random.default_rng(1)
    x, ref = _unit(rng, 2000), _unit(rng, 9000)
    whole = x @ ref.T
    tracemalloc.start()
    at, top = sim._best_of(x, ref, "cosine")
    three, _ = sim._top_of(x, ref, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < whole.nbytes / 3
    assert (at == whole.argmax(axis=1)).all()
    np.testing.assert_allclose(top, whole.max(axis=1), atol=1e-12)
    assert (three == np.argsort(-whole, axis=1, kind="stable")[:, :3]).all()


@pytest.mark.parametrize("k", [1, 3, 20])
def test_equal_sites_of_several_tiles_come_in_order(monkeypatch, k):
    monkeypatch.setattr(sim, "TILE_SITES", 16)
    monkeypatch.setattr(sim, "TILE_CELLS", 64)
    rng = np.random.default_rng(2)
    ref = np.repeat(_unit(rng, 3, 64), 20, axis=0)[rng.permutation(60)]
    x = _unit(rng, 37, 64)
    at, top = sim._top_of(x, ref, k)
    first = np.argsort(-np.round(x @ ref.T, 9), axis=1, kind="stable")[:, :k]
    assert (at == first).all()
    assert (sim._best_of(x, ref, "cosine")[0] == first[:, 0]).all()


def test_missing_sites_are_no_match():
    x, ref = np.eye(2), np.array([[1.0, 0.0], [np.nan, np.nan], [0.0, 1.0]])
    at, top = sim._top_of(x, ref, 3)
    assert at[:, :2].tolist() == [[0, 2], [2, 0]] and np.isnan(top[:, 2]).all()
    assert np.isnan(sim._best_of(x, ref, "cosine")[1]).all()


def test_walked_sites_rewrite_the_patches_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = lambda n: [(i, v.tolist()) for i, v in enumerate(_unit(rng, n))]
    p = spark.createDataFrame(rows(50), "id long, embedding array<double>")
    s = spark.createDataFrame(rows(200), "site_idx long, embedding array<double>")
    written = []
    settle = sim.settle
    monkeypatch.setattr(sim, "settle", lambda df, label: written.append(label) or settle(df, label))
    got = sim.best_match(p, s, "id", max_broadcast_bytes=2 * 4 * 8 * 8, block_rows=4)
    assert len(written) < 10
    want = sim.best_match(p, s, "id").collect()
    assert sorted(r["best_idx"] for r in got.collect()) == sorted(r["best_idx"] for r in want)


def test_kmeans_passes_over_packed_vectors(spark):
    from gridsieve.operators.models import clusters

    x = np.random.default_rng(4).normal(size=(3000, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    packed = clusters._pack(df.select("id", "v").repartition(3), 5)
    assert packed.count() <= 3 * (1000 // clusters.PACKED + 2)
    centres = x[:8].reshape(2, 4, 5)
    for few in (True, False):
        sums = clusters._member_sums(packed, centres, few)
        for f in range(2):
            gap = ((x[:, None] - centres[f][None]) ** 2).sum(axis=2)
            at = gap.argmin(axis=1)
            assert sums[f, :, 0].tolist() == np.bincount(at, minlength=4).tolist()
            np.testing.assert_allclose(sums[f, :, 1].sum(), gap.min(axis=1).sum())
            np.testing.assert_allclose(sums[f, 1, 2:], x[at == 1].sum(axis=0))


def test_blocks_unfold_in_many_tasks(spark):
    from gridsieve.operators import mosaic

    blocks = spark.range(300).selectExpr(
        "'A' AS aoi", "cast(id / 20 AS int) AS r", "cast(id % 20 AS int) AS c", "0.5D AS v"
    ).coalesce(1)
    pixels = mosaic.expand_blocks(blocks, 4, "v")
    assert pixels.count() == 4800
    assert pixels.select(F.spark_partition_id().alias("p")).distinct().count() > 4
