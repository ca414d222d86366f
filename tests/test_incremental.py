"""Scoring of arrivals that are not stored yet."""

import pytest
from pyspark.sql import functions as F

from gridsieve.streaming import scoring as st

SCHEMA = "patch_id string, ts long, x double"


def arrive(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def score(rows):
    return rows.withColumn("s", F.col("x") * 2)


def run(spark, root, checkpoint, fn=score):
    stream = st.read_stream(spark, f"{root}/in", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
    return st.run_incremental(stream, f"{root}/store", f"{root}/{checkpoint}", fn, order="ts")


def stored(spark, root):
    schema = score(spark.createDataFrame([], SCHEMA)).schema
    return sorted(
        (tuple(r) for r in st.committed_rows(spark, f"{root}/store", schema).collect()), key=str
    )


def test_repeats_restarts_and_a_lost_checkpoint(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/in", [("a", 2, 1.0), ("a", 1, 3.0), ("a", 1, 2.0), ("b", 5, 4.0), (None, 1, 1.0)])
    progress = run(spark, root, "c1")
    want = [("a", 1, 2.0, 4.0), ("b", 5, 4.0, 8.0), (None, 1, 1.0, 2.0)]
    assert stored(spark, root) == want
    assert all(not p["stateOperators"] for p in progress)
    # later files: a repeat, a late one, a null key again
    arrive(spark, f"{root}/in", [("a", 0, 9.0), ("c", -7, 1.0), (None, 0, 5.0)])
    run(spark, root, "c1")
    want = sorted([*want, ("c", -7, 1.0, 2.0)], key=str)
    assert stored(spark, root) == want
    run(spark, root, "c2")
    assert stored(spark, root) == want
    run(spark, root, "c2")
    assert stored(spark, root) == want


def test_a_broken_write_is_not_read_and_is_done_again(spark, tmp_path):
    root = str(tmp_path)
    arrive(spark, f"{root}/in", [("a", 1, 1.0)])
    run(spark, root, "c1")
    # rows whose batch broke before its commit record
    left = score(spark.createDataFrame([("z", 1, 1.0)], SCHEMA))
    left.write.parquet(f"{root}/store/rows/part=broken-0")
    assert [r[0] for r in stored(spark, root)] == ["a"]
    arrive(spark, f"{root}/in", [("z", 2, 3.0)])
    failing = lambda rows: rows.select("*", F.raise_error(F.lit("lost")).cast("double").alias("s"))
    with pytest.raises(Exception):
        run(spark, root, "c1", failing)
    assert [r[0] for r in stored(spark, root)] == ["a"]
    run(spark, root, "c1")
    assert stored(spark, root) == [("a", 1, 1.0, 2.0), ("z", 2, 3.0, 6.0)]
    # a batch done again under the same name after it was committed stores nothing twice
    batch = spark.createDataFrame([("z", 2, 3.0)], SCHEMA)
    for part in ("other-0", "other-0", "other-1"):
        st.store_new(batch.union(spark.createDataFrame([("y", 1, 1.0)], SCHEMA)), f"{root}/store", part, score)
        assert [r[0] for r in stored(spark, root)] == ["a", "y", "z"]


def test_an_empty_batch(spark, tmp_path):
    store = str(tmp_path / "store")
    empty = spark.createDataFrame([], SCHEMA)
    st.store_new(empty, store, "e-0", score)
    assert st.committed_rows(spark, store, score(empty).schema).count() == 0
