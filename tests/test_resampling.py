"""Turned grids, large templates, listed files and window counts without state."""

import numpy as np
import pytest
from conftest import as_array, raster
from pyspark.sql import functions as F

from gridsieve.operators import correlation, resampling
from gridsieve.sources import readers, sinks
from gridsieve.streaming import scoring as st

RNG = np.random.default_rng(11)


def _map(angle, scale=1.0, centre=(9.3, 7.1), middle=(8.0, 8.0)):
    c, s = np.cos(np.radians(angle)) * scale, np.sin(np.radians(angle)) * scale
    m = {"a": c, "b": -s, "d": s, "e": c}
    return m | {
        "c": centre[1] - c * middle[1] + s * middle[0],
        "f": centre[0] - s * middle[1] - c * middle[0],
    }


def _by_hand(z, m, height, width):
    out = np.full((height, width), np.nan)
    for r in range(height):
        for q in range(width):
            x = round(m["a"] * q + m["b"] * r + m["c"], 9)
            y = round(m["d"] * q + m["e"] * r + m["f"], 9)
            i, j = int(np.floor(y)), int(np.floor(x))
            total = weight = 0.0
            for di in (0, 1):
                for dj in (0, 1):
                    a, b = i + di, j + dj
                    if 0 <= a < z.shape[0] and 0 <= b < z.shape[1] and not np.isnan(z[a, b]):
                        w = (1 - abs(y - a)) * (1 - abs(x - b))
                        total, weight = total + w * z[a, b], weight + w
            if weight > 0:
                out[r, q] = total / weight
    return out


def _grids(spark, m, height, width, areas=("A",)):
    rows = [(a, height, width, *[float(m[k]) for k in resampling.AFFINE]) for a in areas]
    return spark.createDataFrame(rows, "aoi string, height int, width int, a double, b double, c double, d double, e double, f double")


@pytest.mark.parametrize("angle,scale,share", [(30, 1.0, 1 << 16), (30, 1.0, 9), (-75, 2.6, 40), (0, 1.0, 16), (45, 0.3, 25)])
def test_turned_grid_equals_brute_force(spark, monkeypatch, angle, scale, share):
    monkeypatch.setattr(resampling, "PIXELS_PER_BLOCK", share)
    z = RNG.uniform(1, 50, size=(19, 15))
    z[RNG.uniform(size=z.shape) < 0.2] = np.nan
    m = _map(angle, scale)
    got = resampling.resample_affine(raster(spark, "A", dtm=z), _grids(spark, m, 17, 16), ["dtm"])
    assert got.count() == 17 * 16
    np.testing.assert_allclose(as_array(got, "dtm", 17, 16), _by_hand(z, m, 17, 16), atol=1e-9)


def test_turned_grid_odd_cases(spark):
    z = RNG.uniform(size=(5, 5))
    m = _map(30)
    px = raster(spark, "A", dtm=z)
    both = resampling.resample_affine(px, _grids(spark, m, 3, 2, ("A", "B")), ["dtm"])
    counts = {r["aoi"]: (r["n"], r["v"]) for r in both.groupBy("aoi").agg(F.count("*").alias("n"), F.count("dtm").alias("v")).collect()}
    assert counts["B"] == (6, 0) and counts["A"][0] == 6
    assert resampling.resample_affine(px, _grids(spark, m, 0, 2), ["dtm"]).count() == 0
    assert resampling.resample_affine(px.limit(0), _grids(spark, m, 2, 2), ["dtm"]).where("dtm is null").count() == 4
    flat = m | {"a": 1.0, "b": 2.0, "d": 2.0, "e": 4.0}
    with pytest.raises(Exception, match="no inverse"):
        resampling.resample_affine(px, _grids(spark, flat, 2, 2), ["dtm"]).collect()
    with pytest.raises(ValueError):
        resampling.resample_affine(px, _grids(spark, m, 2, 2), ["dtm"], "cubic")


def test_nearest_on_a_quarter_turn_moves_values(spark):
    z = np.arange(12.0).reshape(3, 4) + 1
    m = {"a": 0.0, "b": 1.0, "c": 0.0, "d": 1.0, "e": 0.0, "f": 0.0}
    got = resampling.resample_affine(raster(spark, "A", dtm=z), _grids(spark, m, 4, 3), ["dtm"], "nearest")
    np.testing.assert_array_equal(as_array(got, "dtm", 4, 3), z.T)


@pytest.mark.parametrize("shape", [(3, 3), (7, 5), (16, 16), (1, 16)])
def test_transforms_equal_direct_sums(shape, monkeypatch):
    x, t = RNG.normal(50, 20, size=(4, 16, 16)), RNG.normal(size=shape)
    fast = next(correlation.valid_correlations(x, [t]))
    monkeypatch.setattr(correlation, "DIRECT_CELLS", 10_000)
    np.testing.assert_allclose(fast, next(correlation.valid_correlations(x, [t])), atol=1e-9)
    with pytest.raises(ValueError):
        next(correlation.valid_correlations(x, [np.ones((17, 2))]))


def test_template_field_across_blocks(spark):
    z = RNG.uniform(1, 50, size=(23, 19))
    z[4, 5] = np.nan
    t = RNG.normal(size=(8, 6))
    px = raster(spark, "A", dtm=z)
    got = correlation.template_field(px, t, "dtm", block=3)
    f = np.nan_to_num(z)
    win = np.lib.stride_tricks.sliding_window_view(f, t.shape)
    want = (win * t).sum(axis=(2, 3)) / (
        np.sqrt((win * win).sum(axis=(2, 3))) * np.sqrt((t * t).sum()) + 1e-10
    )
    assert got.count() == want.size
    np.testing.assert_allclose(as_array(got, "similarity", *want.shape), want, atol=1e-9)
    # A pixel that is not there makes no whole window.
    gap = px.where("not (row = 10 and col = 10)")
    assert correlation.template_field(gap, t, "dtm", block=3).count() == want.size - 8 * 6
    assert correlation.template_field(px.limit(0), t, "dtm").count() == 0


def test_area_files_lists_both_layouts_and_prunes(spark, tmp_path):
    for name in ("AOI_0003/sentinel/NDVI.tif", "AOI_0004/lidar/dtm.tif", "other/ndvi.tif"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"xx")
    bands = spark.createDataFrame(
        [("AOI_0007", "ndvi", 0, 0, 1.0), ("AOI_0007", "dtm", 5000, 0, 1.0)],
        "aoi string, band string, row int, col int, value double",
    )
    sinks.write_band_files(bands, str(tmp_path), mode="append")
    files = readers.area_files(spark, str(tmp_path))
    rows = {(r["aoi"], r["aoi_index"], r["band"]) for r in files.where("length > 0").collect()}
    assert rows == {("AOI_0003", 3, "ndvi"), ("AOI_0004", 4, "dtm"), ("AOI_0007", 7, "ndvi"), ("AOI_0007", 7, "dtm")}
    assert {r["aoi"] for r in readers.areas_in_paths(files).collect()} == {"AOI_0003", "AOI_0007"}
    some = readers.area_files(spark, str(tmp_path), ["AOI_0004", "AOI_0007", "AOI_0099"])
    assert {r["aoi"] for r in some.collect()} == {"AOI_0004", "AOI_0007"}
    with pytest.raises(Exception):
        readers.area_files(spark, str(tmp_path), ["AOI_0099"]).collect()


def test_patch_file_names(spark):
    paths = ["/p/AOI_0001_all_patches.npz", "/p/file=AOI_0002_all_patches.npz/part-0.parquet",
             "/p/AOI_0003_all_patches/part-1.parquet", "/p/AOI_0004_patches.npz", "/p/BAOI_0005_all_patches.npz"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r["aoi"] for r in readers.areas_from_patch_files(files).collect()} == {"AOI_0001", "AOI_0002", "AOI_0003"}


def test_window_counts_without_state_take_late_events(spark, tmp_path):
    src, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))
    hourly = lambda rows: st.window_counts(rows, "ts", ["kind"], "1 hour")
    first = [("2024-01-01 00:10:00", "a"), ("2024-01-01 05:10:00", "a"), ("2024-01-01 05:50:00", "b")]
    late = [("2024-01-01 00:20:00", "a"), ("2023-12-01 00:20:00", "b"), (None, "b")]
    seen = []
    for events in (first, late):
        rows = spark.createDataFrame(events, "ts string, kind string").withColumn("ts", F.col("ts").cast("timestamp"))
        rows.write.mode("append").parquet(src)
        stream = st.read_stream(spark, src, rows.schema, files_per_batch=1)
        seen += st.run_partials(stream, out, mark, hourly)
    # A restart without new files changes nothing.
    seen += st.run_partials(st.read_stream(spark, src, rows.schema), out, mark, hourly)
    assert seen and all(not p["stateOperators"] for p in seen)
    schema = hourly(rows).schema
    got = st.summed_rows(spark, out, schema, ["window_start", "kind"])
    want = hourly(spark.read.parquet(src))
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    assert got.agg(F.sum("n")).first()[0] == 5
    assert st.summed_rows(spark, out, schema, ["window_start", "kind"], "2024-01-01 05:00:00").count() == 2
