"""Scoring and counting on streams with the same column expressions as in batch."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_anomaly
from ..operators.models.gate import gate_score


def read_stream(
    spark: SparkSession, path: str, schema, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def score_patches(stream: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    """Stateless scoring, so it runs unchanged on a batch or a stream."""
    scored = gate_score(stream, model)
    p = F.col("gate_prediction")
    return scored.withColumns({"is_anomaly": is_anomaly(p), "detected": p >= threshold})


def first_arrivals(stream: DataFrame, key: str = "patch_id") -> DataFrame:
    """Each patch once, however late it comes.

    The state holds one key per patch seen; on large streams keep it on disk with the
    RocksDB state store.
    """
    return stream.dropDuplicates([key])


def window_counts(stream: DataFrame, time: str, keys: list[str], width: str) -> DataFrame:
    """Tumbling counts of all events, late ones included.

    On a stream the state holds one count per window and key, so it grows with time, not
    with events; ``run_partials`` needs no state.
    """
    return (
        stream.groupBy(F.window(time, width).alias("w"), *keys)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("w.start").alias("window_start"), *keys, "n")
    )


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Process everything that is there in micro-batches, then stop."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def run_upserts(stream: DataFrame, out: str, checkpoint: str) -> None:
    """As ``run_available`` for changing rows: every micro-batch writes its rows to its own
    folder, and a repeated micro-batch overwrites it."""

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        query.stop()


def latest_rows(spark: SparkSession, out: str, schema, keys: list[str]) -> DataFrame:
    """The last stored row of every key."""
    stored = spark.read.schema(schema.add("batch", "long")).parquet(out)
    values = [c for c in stored.columns if c not in (*keys, "batch")]
    return stored.groupBy(*keys).agg(*[F.max_by(c, "batch").alias(c) for c in values])


def run_partials(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    partial: Callable[[DataFrame], DataFrame],
) -> list[dict]:
    """Aggregate every micro-batch by itself and store its partial rows; returns the progress.

    A late event is a row of a later batch that adds to a window counted before, so nothing is
    dropped, no watermark is needed, and the stream keeps no state at all.  A repeated
    micro-batch overwrites its own folder.  ``summed_rows`` adds the partial rows up.
    """

    def store(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = (
        stream.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
        return list(query.recentProgress)
    finally:
        query.stop()


def summed_rows(
    spark: SparkSession, out: str, schema: T.StructType, keys: list[str], since=None
) -> DataFrame:
    """Partial rows of all micro-batches added up by ``keys``; all other columns are sums.

    With ``since`` only windows that start then or later are read.
    """
    stored = spark.read.schema(schema).parquet(out)
    if since is not None:
        stored = stored.where(F.col("window_start") >= F.lit(since))
    values = [f.name for f in schema.fields if f.name not in keys]
    return stored.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in values])


# ---- scoring what is not stored yet ----------------------------------------


def committed_rows(spark: SparkSession, store: str, schema: T.StructType) -> DataFrame:
    """Rows of ``store`` whose micro-batch has a commit record; rows of broken writes are not read.

    The records are one row per micro-batch; they join the folder names, so folders without
    one are skipped before they are read.
    """
    records = spark.read.schema("part string, n long").json(f"{store}/commits/*")
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.StringType())]))
    return rows.parquet(f"{store}/rows").join(records, "part", "left_semi").drop("part")


def store_new(
    batch: DataFrame,
    store: str,
    part: str,
    score: Callable[[DataFrame], DataFrame],
    key: str = "patch_id",
    order: str | None = None,
) -> None:
    """Score and store the rows of ``batch`` whose key has no committed row yet.

    Of rows that share a key the one with the least ``order`` is kept, then the least by the
    other columns; null keys count as one key.  They meet in a grouped minimum, so a hot key is
    reduced before it is shuffled.  Only then are the rows scored.  The commit record is
    written after the rows are complete: a repeat of a broken batch replaces its rows, and a
    repeat of a finished one, under the same ``part`` or another, stores no key twice.
    """
    spark = batch.sparkSession
    if _exists(spark, f"{store}/commits/{part}/_SUCCESS"):
        return
    first = [order] if order else []
    others = [c for c in batch.columns if c not in (key, order)]
    least = F.min(F.struct(*first, *others)).alias("__row")
    once = batch.groupBy(key).agg(least).select(key, "__row.*").select(*batch.columns)
    if _exists(spark, f"{store}/commits"):
        field = batch.schema[key]
        stored = committed_rows(spark, store, T.StructType([field])).withColumnRenamed(key, "__key")
        once = once.join(stored, F.col(key).eqNullSafe(F.col("__key")), "left_anti")
    rows = f"{store}/rows/part={part}"
    score(once).write.mode("overwrite").parquet(rows)
    counted = spark.read.parquet(rows).agg(F.count(F.lit(1)).alias("n"))
    record = counted.select(F.lit(part).alias("part"), "n")
    record.write.mode("overwrite").json(f"{store}/commits/{part}")


def run_incremental(
    stream: DataFrame,
    store: str,
    checkpoint: str,
    score: Callable[[DataFrame], DataFrame],
    key: str = "patch_id",
    order: str | None = None,
) -> list[dict]:
    """Score what has arrived and is not stored yet, then stop; returns the batches' progress.

    The store itself says what is known, so the stream keeps no state, late rows need no
    watermark, and a lost checkpoint only costs reading the input again.  Each micro-batch
    reads the stored keys, one column.  One stream at a time may write to a store.
    """
    run = uuid.uuid4().hex
    query = (
        stream.writeStream.foreachBatch(
            lambda batch, number: store_new(batch, store, f"{run}-{number}", score, key, order)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
        return list(query.recentProgress)
    finally:
        query.stop()


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
