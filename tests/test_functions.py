import numpy as np
import pytest
from pyspark.sql import functions as F

from gridsieve.config import PatchGrid, PreprocessingConfig, ScoringRequest
from gridsieve.functions.quantiles import exact_quantiles
from gridsieve.functions.ranking import (
    ordinal_by_line,
    rank_cut,
    sample_per_group,
    top_k_per_group,
)


@pytest.mark.parametrize("whole", [0, 10_000_000])
def test_quantiles_match_linear_interpolation(spark, whole):
    rng = np.random.default_rng(1)
    # One group holds most rows, one is tiny, one has heavy ties.
    values = {"hot": rng.normal(size=9000), "tiny": np.array([3.0, 1.0]), "ties": np.repeat([1.0, 2.0, 9.0], 700)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("hot", None), ("hot", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = {"a": 0.005, "m": 0.5, "z": 0.995, "top": 1.0}
    # A small accuracy makes the bracketed way collapse most cells.
    got = exact_quantiles(df, ["k"], "v", probs, accuracy=200, whole_group_rows=whole).collect()
    for r in got:
        want = np.quantile(values[r["k"]], list(probs.values()))
        assert r["n"] == len(values[r["k"]])
        np.testing.assert_allclose([r[n] for n in probs], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("whole", [0, 10_000_000])
def test_global_quantile(spark, whole):
    df = spark.range(1, 5002).select(F.col("id").cast("double").alias("v"))
    r = exact_quantiles(df, [], "v", {"m": 0.5, "p": 0.1}, accuracy=100, whole_group_rows=whole).first()
    assert (r["n"], r["m"], r["p"]) == (5001, 2501.0, 501.0)


def test_top_k_keeps_exactly_k_of_a_hot_group(spark):
    df = spark.range(2000).select(
        F.when(F.col("id") < 1900, "hot").otherwise("cold").alias("g"), F.col("id").alias("v")
    )
    got = top_k_per_group(df, ["g"], [F.desc("v")], 5, ["v"], rank_as="r").collect()
    hot = sorted((r["r"], r["v"]) for r in got if r["g"] == "hot")
    assert hot == [(i + 1, 1899 - i) for i in range(5)]


def test_sample_is_exact_and_deterministic(spark):
    df = spark.range(30_000).select(
        F.when(F.col("id") < 29_950, "hot").otherwise("few").alias("g"), "id"
    )
    a = sample_per_group(df, ["g"], ["id"], 100).collect()
    b = sample_per_group(df.repartition(7), ["g"], ["id"], 100).collect()
    assert sorted(a) == sorted(b)
    assert sum(r["g"] == "hot" for r in a) == 100
    assert sum(r["g"] == "few" for r in a) == 50


def test_rank_cut_sizes_and_strata(spark):
    df = spark.range(1003).select(F.concat(F.lit("p"), "id").alias("k"), (F.col("id") % 10 == 0).cast("int").alias("y"))
    assert rank_cut(df, ["k"], 0.8).where("in_train").count() == 802
    counts = {
        (r["y"], r["in_train"]): r["count"]
        for r in rank_cut(df, ["k"], 0.8, strata="y").groupBy("y", "in_train").count().collect()
    }
    assert counts == {(0, True): 721, (0, False): 181, (1, True): 80, (1, False): 21}


def test_ordinals_follow_row_then_col(spark):
    df = spark.createDataFrame([("a", 8, 0), ("a", 0, 8), ("a", 0, 0), ("b", 16, 4)], "aoi string, row int, col int")
    got = {(r["aoi"], r["row"], r["col"]): r["ordinal"] for r in ordinal_by_line(df, "aoi", "row", "col").collect()}
    assert got == {("a", 0, 0): 0, ("a", 0, 8): 1, ("a", 8, 0): 2, ("b", 16, 4): 0}


def test_argument_checks():
    PreprocessingConfig(64, 32)
    for bad in (
        dict(patch_size=48), dict(patch_size=1024), dict(stride=4), dict(stride=128),
        dict(min_valid_ratio=1.5), dict(clip_percentile=(99, 1)), dict(target_patches=0),
    ):
        with pytest.raises(ValueError):
            PreprocessingConfig(**bad)
    for bad in (dict(threshold=1.1), dict(batch_size=0), dict(batch_size=513), dict(top_n=21)):
        with pytest.raises(ValueError):
            ScoringRequest(**bad)
    with pytest.raises(ValueError):
        PatchGrid(16, 32)


def test_ranks_are_found_whatever_the_values(spark):
    """Values no sketch brackets: far outliers, infinities, heavy ties, neighbouring doubles."""
    rng = np.random.default_rng(2)
    near = 1.0 + np.arange(60) * np.finfo(float).eps
    values = {
        "decades": np.concatenate((10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-9, 9, 99)))),
        "endless": np.array([-np.inf, -np.inf, 0.0, 1.0, 5.0, np.inf]),
        "near": rng.permutation(np.repeat(near, 3)),
        "wide": np.array([-1.7e308, 1.7e308, 0.0, -5e-324, 5e-324]),
        "ties": np.repeat([4.0, -0.0, 7.0], [500, 300, 1]),
    }
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    probs = {"a": 0.0, "b": 0.2, "c": 0.5, "d": 1.0}
    got = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, 64, whole_group_rows=0).collect()}
    for k, vs in values.items():
        ordered = np.sort(vs)
        for name, p in probs.items():
            h = p * (len(vs) - 1)
            low, high = ordered[int(np.floor(h))], ordered[int(np.ceil(h))]
            want = low if low == high else low + (high - low) * (h - np.floor(h))
            np.testing.assert_allclose(got[k][name], want, rtol=1e-15)


def test_no_values_give_no_quantiles(spark):
    empty = spark.createDataFrame([(None, "a")], "v double, k string")
    assert exact_quantiles(empty, ["k"], "v", {"m": 0.5}, whole_group_rows=0).count() == 0
