import numpy as np
import pytest
from conftest import as_array, raster
from pyspark.sql import functions as F

from gridsieve.config import PatchGrid
from gridsieve.operators import channels as ch
from gridsieve.operators import mosaic
from gridsieve.operators import patches as pt
from gridsieve.operators import terrain


def _holes(h, w, seed=3):
    rng = np.random.default_rng(seed)
    z = rng.uniform(1, 50, size=(h, w))
    z[rng.uniform(size=(h, w)) < 0.15] = np.nan
    return z


def _reference_terrain(z):
    f = np.where(np.isnan(z), np.nanmedian(z), z)
    e = np.pad(f, 1, mode="symmetric")
    win = np.lib.stride_tricks.sliding_window_view(e, (3, 3))
    smooth, diff = np.array([1, 2, 1]), np.array([-1, 0, 1])
    gx = np.einsum("ijkl,k,l->ij", win, smooth, diff)
    gy = np.einsum("ijkl,k,l->ij", win, diff, smooth)
    slope = np.degrees(np.arctan(np.hypot(gx, gy)))
    rough = win.std(axis=(2, 3))
    slope[np.isnan(z)] = np.nan
    rough[np.isnan(z)] = np.nan
    return slope, rough


@pytest.mark.parametrize("shape", [(13, 11), (1, 20), (20, 1)])
def test_slope_and_roughness_across_blocks(spark, shape):
    z = _holes(*shape)
    out = terrain.terrain_derivatives(raster(spark, "A", dtm=z), block=4)
    slope, rough = _reference_terrain(z)
    assert out.count() == z.size
    np.testing.assert_allclose(as_array(out, "slope", *shape), slope, atol=1e-9)
    np.testing.assert_allclose(as_array(out, "roughness", *shape), rough, atol=1e-7)


def test_too_few_valid_pixels_give_no_derivative(spark):
    z = np.full((4, 4), np.nan)
    z[0, :] = 5.0
    out = terrain.terrain_derivatives(raster(spark, "A", dtm=z))
    assert out.where("slope is not null or roughness is not null").count() == 0


def test_unusable_elevation_is_dropped(spark):
    good, flat = np.full((12, 12), 3.0), np.full((12, 12), 0.05)
    df = raster(spark, "good", dtm=good).union(raster(spark, "flat", dtm=flat))
    for out in (ch.drop_unusable_dtm(df), terrain.terrain_derivatives(df, drop_unusable=True)):
        n = {r["aoi"]: r["n"] for r in out.groupBy("aoi").agg(F.count("dtm").alias("n")).collect()}
        assert n == {"good": 144, "flat": 0}


def test_hillshade_identity(spark):
    """Opposite directions cancel, so the mean shade is sin(45) * sin(slope)."""
    out = terrain.hillshade(raster(spark, "A", dtm=_holes(9, 9)), block=4).collect()
    for r in out:
        assert abs(r["shade"] - np.sin(np.pi / 4) * np.sin(r["slope_rad"])) < 1e-9
        assert 0 <= r["shade_byte"] <= 255


@pytest.mark.parametrize("shape,size,block", [((17, 9), 5, 4), ((3, 4), 15, 8), ((1, 30), 7, 6)])
def test_separable_filter_mirrors_edges(spark, shape, size, block):
    z = np.nan_to_num(_holes(*shape), nan=7.0)
    kernel = np.random.default_rng(0).uniform(size=size)
    got = as_array(
        terrain.separable_filter(raster(spark, "A", v=z), "v", kernel, "out", block), "out", *shape
    )
    r = size // 2
    e = np.pad(z, r, mode="symmetric")
    win = np.lib.stride_tricks.sliding_window_view(e, (size, size))
    np.testing.assert_allclose(got, np.einsum("ijkl,k,l->ij", win, kernel, kernel), atol=1e-9)


def test_general_roughness_equals_three_tap(spark):
    z = _holes(10, 8)
    got = as_array(terrain.roughness_window(raster(spark, "A", dtm=z), 3, block=4), "roughness", 10, 8)
    np.testing.assert_allclose(got, _reference_terrain(z)[1], atol=1e-6)


@pytest.mark.parametrize("p,s,cpb", [(6, 3, 2), (6, 4, 2), (4, 4, 1), (5, 2, 3)])
def test_patches_equal_slices(spark, p, s, cpb):
    h, w = 19, 14
    z, v = _holes(h, w, 1), _holes(h, w, 2)
    px = raster(spark, "A", dtm=z, ndvi=v)
    grid = PatchGrid(p, s)
    want = {}
    for r in range(0, h - p + 1, s):
        for c in range(0, w - p + 1, s):
            n = np.isfinite(v[r : r + p, c : c + p]).sum()
            if n / p**2 >= 0.8:
                want[r, c] = (n, z[r : r + p, c : c + p].ravel())
    cut = pt.extract_patches(px, grid, 0.8, ("dtm", "ndvi"), corners_per_block=cpb).collect()
    assert {(r["row"], r["col"]) for r in cut} == set(want)
    for r in cut:
        n, cells = want[r["row"], r["col"]]
        assert r["n_valid"] == n
        got = np.array([np.nan if x is None else x for x in r["dtm"]])
        np.testing.assert_array_equal(got, cells)
    pooled = pt.mean_pool_channels(px, grid, 0.8, ("dtm",)).collect()
    assert {(r["row"], r["col"]) for r in pooled} == set(want)
    for r in pooled:
        cells = want[r["row"], r["col"]][1]
        assert abs(r["dtm_mean"] - np.nanmean(cells)) < 1e-9
        assert abs(r["dtm_std"] - np.nanstd(cells)) < 1e-6


def test_area_smaller_than_a_patch_gives_nothing(spark):
    px = raster(spark, "A", dtm=np.ones((5, 30)), ndvi=np.ones((5, 30)))
    assert pt.extract_patches(px, PatchGrid(8, 4), 0.7, ("dtm", "ndvi")).count() == 0
    assert pt.valid_patches(px, PatchGrid(8, 4)).count() == 0


def test_stats_of_empty_and_flat_channels(spark):
    flat, none = np.full((6, 6), 4.0), np.full((6, 6), np.nan)
    px = raster(spark, "A", dtm=flat, ndvi=none)
    st = {r["channel"]: tuple(r)[1:] for r in ch.global_stats(px, ("dtm", "ndvi")).collect()}
    assert st == {"dtm": (4.0, 1.0, 4.0, 4.0), "ndvi": (0.0, 1.0, 0.0, 1.0)}
    normal = ch.normalize_channels(px, ch.global_stats(px, ("dtm", "ndvi")), ("dtm", "ndvi"))
    assert normal.where("dtm <> 0 or ndvi is not null").count() == 0


def test_normalised_values_stay_in_clip_range(spark):
    px = raster(spark, "A", dtm=_holes(20, 20))
    st = ch.global_stats(px, ("dtm",), per_area=None)
    s = st.first()
    r = ch.normalize_channels(px, st, ("dtm",)).agg(F.min("dtm"), F.max("dtm")).first()
    assert r[0] >= (s["p_low"] - s["mean"]) / s["std"] - 1e-12
    assert r[1] <= (s["p_high"] - s["mean"]) / s["std"] + 1e-12


def test_mosaic_of_constant_patches_is_constant(spark):
    grid = PatchGrid(8, 4)
    px = raster(spark, "A", dtm=np.full((20, 16), 2.5), ndvi=np.ones((20, 16)))
    cut = pt.extract_patches(px, grid, 0.7, ("dtm", "ndvi"))
    whole = mosaic.mosaic_weighted(pt.explode_patches(cut, 8, ("dtm", "ndvi")), 8, ["dtm"])
    assert whole.where("abs(dtm - 2.5) > 1e-12").count() == 0
    c = mosaic.mosaic_coverage(whole, mosaic.area_extent(cut, 8)).first()
    assert (c["covered"], c["coverage_pct"]) == (320, 100.0)


def test_block_heatmap_equals_pixel_average(spark):
    rows = [("A", f"p{r}{c}", r, c, float(r + 2 * c)) for r in (0, 4, 12) for c in (0, 4, 16)]
    s = spark.createDataFrame(rows, "aoi string, patch_id string, row int, col int, s double")
    total, count = np.zeros((20, 24)), np.zeros((20, 24))
    for _, _, r, c, v in rows:
        total[r : r + 8, c : c + 8] += v
        count[r : r + 8, c : c + 8] += 1
    want = total / np.maximum(count, 1)
    for grid in (PatchGrid(8, 4), PatchGrid(8, 3)):
        got = as_array(mosaic.heatmap_mean(s, grid, "s"), "s", 20, 24)
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_resample_renormalises_over_missing(spark):
    src = raster(spark, "A", dtm=[[1.0, np.nan], [3.0, 4.0]])
    tgt = spark.createDataFrame(
        [("A", 0, 0, 0.5, 0.5), ("A", 0, 1, 0.0, 1.0), ("A", 1, 0, 0.25, 0.0)],
        "aoi string, row int, col int, src_row double, src_col double",
    )
    got = {(r["row"], r["col"]): r["dtm"] for r in ch.resample(src, tgt, "dtm").collect()}
    assert got[0, 0] == pytest.approx(8 / 3)
    assert got[0, 1] is None
    assert got[1, 0] == pytest.approx(1.5)
    near = {(r["row"], r["col"]): r["dtm"] for r in ch.resample(src, tgt, "dtm", "nearest").collect()}
    assert near == {(0, 0): 4.0, (0, 1): None, (1, 0): 1.0}
