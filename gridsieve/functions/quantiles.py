"""Exact grouped quantiles without holding a group in one task.

The built-in ``percentile`` keeps every distinct value of a group in one map.  Here each
wanted rank is narrowed down round by round: a mergeable histogram of the range that holds
the rank says in which cell it lies, and the least and largest value of that cell are the
next range, until they are equal.  Nothing is sorted, no rank can be missed, and a round
moves at most ``accuracy`` cells for each range and task.  The result is the same linear
interpolation as ``percentile``.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import attach_small, settle

# Cells of one histogram; five rounds tell 10^21 equal parts of a range apart.
CELLS = 1 << 14

_TARGETS = "array<struct<rank:bigint,below:bigint,lo:double,hi:double>>"


def exact_quantiles(
    df: DataFrame,
    keys: list[str],
    value: str,
    probs: dict[str, float],
    accuracy: int = CELLS,
    whole_group_rows: int = 500_000,
) -> DataFrame:
    """One row per group: ``n`` and one column per entry of ``probs``.

    If no group has more than ``whole_group_rows`` values, the built-in aggregate does it in
    one pass; otherwise all groups go through the histograms, with the same result.
    """
    base = df.select(*keys, F.col(value).cast("double").alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    spans = base.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )
    spans = settle(spans, "spans")
    largest = spans.agg(F.max("n")).first()[0] or 0
    if largest <= whole_group_rows:
        wanted = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs.values()]))
        counted = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), wanted.alias("__q"))
        return counted.select(
            *keys, "n", *[F.col("__q")[i].alias(name) for i, name in enumerate(probs)]
        )
    state = _select_ranks(base.withColumn("__g", F.lit(0)), spans, keys, probs, max(accuracy, 3))
    at = lambda rank: F.filter("__t", lambda t: t["rank"] == rank)[0]["lo"]
    out = []
    for name, p in probs.items():
        h = F.lit(float(p)) * (F.col("n") - 1)
        low, high = (at(f(h).cast("bigint")) for f in (F.floor, F.ceil))
        between = low + (high - low) * (h - F.floor(h))
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    return state.select(*keys, "n", *out)


def _select_ranks(
    base: DataFrame, spans: DataFrame, keys: list[str], probs: dict[str, float], cells: int
) -> DataFrame:
    """(keys, n, __t): for every wanted rank the value that holds it, as ``lo``."""
    ranks = F.array_distinct(
        F.array(
            *[
                f(F.lit(float(p)) * (F.col("n") - 1)).cast("bigint")
                for p in probs.values()
                for f in (F.floor, F.ceil)
            ]
        )
    )
    target = lambda rank: F.struct(
        rank.alias("rank"), F.lit(0).cast("bigint").alias("below"),
        F.col("__lo").alias("lo"), F.col("__hi").alias("hi"),
    )
    groups = ["__g", *keys]
    state = spans.select(
        F.lit(0).alias("__g"), *keys, "n", F.transform(ranks, target).cast(_TARGETS).alias("__t")
    )
    is_open = lambda t: t["lo"] < t["hi"]
    for turn in count():
        state = settle(state, "ranks")
        open_ = state.select(*groups, F.filter("__t", is_open).alias("__o")).where(F.size("__o") > 0)
        if open_.isEmpty():
            return state
        ranges = settle(
            open_.select(
                *groups,
                F.array_distinct(
                    F.transform("__o", lambda t: F.struct(t["lo"].alias("lo"), t["hi"].alias("hi")))
                ).alias("__r"),
            ),
            "ranges",
        )
        rows = attach_small(base, ranges, groups, "inner")
        inside = F.filter("__r", lambda r: F.col("__v").between(r["lo"], r["hi"]))
        rows = rows.select(*groups, "__v", F.explode(inside).alias("r"))
        at = _cell(F.col("__v"), F.col("r.lo"), F.col("r.hi"), cells, turn % 2 == 1)
        counted = rows.groupBy(*groups, "r.lo", "r.hi", at.alias("i")).agg(
            F.count(F.lit(1)).alias("c"), F.min("__v").alias("least"), F.max("__v").alias("most")
        )
        cell = F.struct("i", "c", "least", "most")
        histograms = counted.groupBy(*groups, "lo", "hi").agg(
            F.array_sort(F.collect_list(cell)).alias("cells")
        )
        # Every target looks its rank up in the histogram of its range.
        targets = state.select(*groups, "n", F.explode("__t").alias("t")).select(
            *groups, "n", "t.*"
        )
        found = targets.join(histograms, [*groups, "lo", "hi"], "left").withColumn(
            "t", F.when(F.col("cells").isNull(), _same()).otherwise(_narrowed())
        )
        state = found.groupBy(*groups, "n").agg(F.collect_list("t").cast(_TARGETS).alias("__t"))


def _same() -> Column:
    return F.struct("rank", "below", "lo", "hi")


def _narrowed() -> Column:
    """The cell that holds the rank, as the next range; ``below`` counts what lies before it."""
    empty = F.lit(None).cast("double")
    start = F.struct(
        F.col("rank").alias("rank"), F.col("below").alias("below"), empty.alias("lo"), empty.alias("hi")
    )

    def step(at: Column, cell: Column) -> Column:
        here = at["lo"].isNull() & (at["below"] + cell["c"] > at["rank"])
        passed = at["lo"].isNull() & ~here
        return F.struct(
            at["rank"].alias("rank"),
            F.when(passed, at["below"] + cell["c"]).otherwise(at["below"]).alias("below"),
            F.when(here, cell["least"]).otherwise(at["lo"]).alias("lo"),
            F.when(here, cell["most"]).otherwise(at["hi"]).alias("hi"),
        )

    return F.aggregate("cells", start, step)


def _cell(v: Column, lo: Column, hi: Column, cells: int, curved: bool) -> Column:
    """Cell of a value in its range, in the order of the values.

    Equal steps put the least value into the first cell and the largest into the last, so a
    range always shrinks.  Every other round takes equal steps of the logarithm instead, to
    get through many orders of magnitude at once.  Infinite ends get cells of their own, so
    that what is left has a finite range.
    """
    endless = (lo == float("-inf")) | (hi == float("inf"))
    if curved:
        unit = F.greatest(F.abs(lo), F.abs(hi)) / 1e290
        bend = lambda x: F.signum(x) * F.log1p(F.abs(x) / F.when(unit > 0, unit))
        width, gone = bend(hi) - bend(lo), bend(v) - bend(lo)
    else:
        # Halves, because a range may be wider than the largest double.
        width, gone = hi / 2.0 - lo / 2.0, v / 2.0 - lo / 2.0
    equal = F.least(F.floor(gone / F.when(width > 0, width) * float(cells)), F.lit(cells - 1))
    return (
        F.when(v == float("-inf"), 0)
        .when(v == float("inf"), cells - 1)
        .when(endless, 1)
        .when(width > 0, equal)
        .otherwise(F.when(v > lo, cells - 1).otherwise(0))
        .cast("int")
    )
