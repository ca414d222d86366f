"""Ranking, sampling and splitting that hold when one group is huge.

A plain ``row_number`` over a group sorts that whole group in one task.  The
helpers here bound what any single task sees: a salted first round for top-k, a
line-wise count for ordinals, and a hash histogram for rank cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import attach_small


def seeded_hash(seed: int | str, *cols: Column) -> Column:
    """Deterministic shuffle key: md5 of the seed and the row's identity."""
    parts = [F.lit(str(seed))] + [c.cast("string") for c in cols]
    return F.md5(F.concat_ws("|", *parts))


def top_k_per_group(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    k: int,
    salt_by: list[str],
    rank_as: str | None = None,
    salts: int = 32,
) -> DataFrame:
    """First ``k`` rows of every group in ``order``, which must be total.

    Each group is cut into ``salts`` parts; every part keeps its own first ``k``
    and only those meet in the second round, so a hot group costs one task at
    most ``salts * k`` rows.
    """
    rank = rank_as or "__rank"
    part = W.partitionBy(*keys, "__salt").orderBy(*order)
    whole = W.partitionBy(*keys).orderBy(*order)
    out = (
        df.withColumn("__salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
        .withColumn("__part", F.row_number().over(part))
        .where(F.col("__part") <= k)
        .drop("__part", "__salt")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= k)
    )
    return out if rank_as else out.drop(rank)


def sample_per_group(
    df: DataFrame,
    keys: list[str],
    identity: list[str],
    n: int,
    seed: int | str = 42,
    limits: DataFrame | None = None,
    hash_column: str | None = None,
) -> DataFrame:
    """Exactly ``n`` rows of every group (all rows if it has fewer), by hash order.

    Group sizes come first.  They tell up to which hash a little more than ``n``
    rows are expected; the other rows are dropped where they are read, so only
    about ``n`` rows per group are shuffled and ordered, however large the group.
    The margin is ten standard deviations, and a shortfall would raise.
    """
    h = hash_column or "__hash"
    rows = df if hash_column else df.withColumn(h, seeded_hash(seed, *[F.col(c) for c in identity]))
    if limits is None:
        limits = hash_limits(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")), n)
    near = attach_small(rows, limits, keys, "inner").where(
        F.substring(h, 1, 8) <= F.col("__limit")
    )
    order = W.partitionBy(*keys).orderBy(h, *identity)
    short = F.raise_error(F.lit("sample fell short of its group")).cast("boolean")
    return (
        near.withColumn("__i", F.row_number().over(order))
        .withColumn("__got", F.count(F.lit(1)).over(W.partitionBy(*keys)))
        .where(F.when(F.col("__got") < F.col("__want"), short).otherwise(F.col("__i") <= n))
        .drop("__i", "__got", "__want", "__limit", h)
    )


def hash_limits(counts: DataFrame, n: int) -> DataFrame:
    """From group sizes ``__n`` the hash prefix below which ``n`` rows surely fall."""
    expected = n + 10.0 * n**0.5 + 100.0
    share = F.floor(F.least(F.lit(expected) / F.col("__n"), F.lit(1.0)) * 4294967295.0)
    return counts.where(F.col("__n") > 0).select(
        *[c for c in counts.columns if c != "__n"],
        F.least(F.col("__n"), F.lit(n)).alias("__want"),
        F.lower(F.lpad(F.hex(share), 8, "0")).alias("__limit"),
    )


def ordinal_by_line(
    df: DataFrame, key: str, line: str, within: str, name: str = "ordinal"
) -> DataFrame:
    """0-based position inside ``key`` in the order ``(line, within)``.

    Rows are counted per line, the line totals are summed up, and only the rows
    of one line are ever sorted together.
    """
    lines = df.groupBy(key, line).agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(key).orderBy(line).rowsBetween(W.unboundedPreceding, -1)
    offsets = lines.select(
        key, line, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset")
    )
    here = W.partitionBy(key, line).orderBy(within)
    return (
        df.withColumn("__here", F.row_number().over(here))
        .join(offsets, [key, line])
        .withColumn(name, F.col("__offset") + F.col("__here") - 1)
        .drop("__here", "__offset")
    )


def rank_cut(
    df: DataFrame,
    identity: list[str],
    fraction: float,
    seed: int | str = 42,
    strata: str | None = None,
    name: str = "in_train",
) -> DataFrame:
    """Mark exactly ``floor(n * fraction)`` rows, picked by seeded hash order.

    A histogram over the first four hex digits of the hash finds the bucket in
    which the cut falls; only that bucket (about 1/65536 of the rows) is sorted.
    """
    hashed = df.withColumn("__h", seeded_hash(seed, *[F.col(c) for c in identity]))
    hashed = hashed.withColumn("__b", F.substring("__h", 1, 4))
    group = [strata] if strata else []
    hist = hashed.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    over = W.partitionBy(*group) if group else W.partitionBy()
    running = over.orderBy("__b").rowsBetween(W.unboundedPreceding, 0)
    targets = (
        hist.withColumn("__cum", F.sum("__n").over(running))
        .withColumn("__k", F.floor(F.sum("__n").over(over) * F.lit(fraction)))
        .where((F.col("__k") > F.col("__cum") - F.col("__n")) & (F.col("__k") <= F.col("__cum")))
        .select(*group, "__b", (F.col("__k") - F.col("__cum") + F.col("__n")).alias("__within"))
    )
    inside = W.partitionBy(*group, "__b").orderBy("__h")
    cut = (
        hashed.select(*group, "__h", "__b")
        .join(targets, [*group, "__b"])
        .withColumn("__i", F.row_number().over(inside))
        .where(F.col("__i") == F.col("__within"))
        .select(*group, F.col("__h").alias("__cut"))
    )
    if group:
        marked = attach_small(hashed, cut, group)
    else:
        marked = hashed.withColumn("__cut", cut.scalar())
    return marked.withColumn(
        name, F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False))
    ).drop("__h", "__b", "__cut")
