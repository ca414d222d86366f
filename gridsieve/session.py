"""Session set-up, the shared scratch folder, and joins with a checked small side."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import types as T

_local_scratch: dict[str, str] = {}
_settled: set[int] = set()
# Folders of the tables settled inside each open ``temporary_tables`` block.
_scopes: list[list[str]] = []
# Drops the shuffle files of a query when it ends, not when its driver object is collected.
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def get_spark(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with the settings the operators rely on."""
    builder = (
        SparkSession.builder.appName("gridsieve")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(32 * 1024 * 1024))
    )
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = (
            builder.config("spark.ui.enabled", "false")
            .config("spark.ui.showConsoleProgress", "false")
            .config("spark.driver.memory", os.environ.get("GRIDSIEVE_LOCAL_MEMORY", "8g"))
        )
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Only a local session,
    as in tests, may fall back to a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="gridsieve-")
    return _local_scratch[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), "gridsieve", f"{label}-{uuid.uuid4().hex}")


# Rows with arrays or bytes can be hundreds of kilobytes.  The Parquet reader decodes up to
# 4096 rows of a row group at once, so their row groups are kept small.
WIDE_ROW_GROUP_BYTES = 8 * 1024 * 1024


def sized_row_groups(df: DataFrame) -> DataFrameWriter:
    """A writer whose row groups bound what a reader holds at a time."""
    wide = any(isinstance(f.dataType, (T.ArrayType, T.BinaryType)) for f in df.schema.fields)
    return df.write.option("parquet.block.size", WIDE_ROW_GROUP_BYTES) if wide else df.write


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Tables settled inside are removed at the end, but for those settled with ``keep``.

    A kept table belongs to the block around this one, if there is one.
    """
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            _remove_folder(spark, path)


def _remove_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def settle(df: DataFrame, label: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, a lost executor costs nothing, the optimizer knows the true size
    of the table, and the shuffle files behind it go.  ``keep`` lets it outlive the
    innermost ``temporary_tables`` block.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    owners = _scopes[:-1] if keep else _scopes
    if owners:
        owners[-1].append(path)
    before = spark.conf.get(_SHUFFLE_CLEANUP)
    spark.conf.set(_SHUFFLE_CLEANUP, "true")
    try:
        sized_row_groups(df).parquet(path)
    finally:
        spark.conf.set(_SHUFFLE_CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    _settled.add(id(table))
    weakref.finalize(table, _settled.discard, id(table))
    return table


def attach_small(big: DataFrame, small: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a table that is normally small, e.g. one row per area.

    The small side is settled, so the optimizer knows its size in bytes.  Below
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and ``big`` is not
    shuffled; above, the join shuffles and adaptive execution splits hot keys.
    """
    known = small if id(small) in _settled else settle(small, "small")
    return big.join(known, on, how)
