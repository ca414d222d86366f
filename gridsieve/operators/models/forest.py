"""Isolation forest: trees grow in parallel, patches are scored by vectorised walks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ...functions.quantiles import exact_quantiles
from ...session import settle
from ..similarity import rows_as_matrix

# Forest size, sample per tree, share taken as anomalous, and seed.
TREES = 100
SAMPLE = 256
CONTAMINATION = 0.05
SEED = 42

NODE_SCHEMA = (
    "tree int, node int, feature int, threshold double, left int, right int, "
    "depth int, size int"
)


def average_path(n):
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    longer = 2.0 * (np.log(big - 1.0) + np.euler_gamma) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, longer))


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree; a leaf has feature -1."""
    nodes: list[tuple] = []
    pending = [(points, 0, None, None)]
    while pending:
        rows, depth, parent, side = pending.pop()
        me = len(nodes)
        if parent is not None:
            nodes[parent][side] = me
        spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
        if depth >= limit or len(spread) == 0:
            nodes.append([me, -1, 0.0, -1, -1, depth, len(rows)])
            continue
        feature = int(rng.choice(spread))
        column = rows[:, feature]
        cut = float(rng.uniform(column.min(), column.max()))
        low = column <= cut
        nodes.append([me, feature, cut, -1, -1, depth, len(rows)])
        pending.append((rows[~low], depth + 1, me, 4))
        pending.append((rows[low], depth + 1, me, 3))
    return nodes


def grow_forest(
    rows: DataFrame,
    key: str,
    vector: str,
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = SEED,
) -> DataFrame:
    """Node table of the forest.

    Each tree draws its own ``sample`` from all rows with a vector: one scan lets every row
    try every tree by a hash limit from the row count, so about ``trees * sample`` rows
    leave it, and each tree keeps the smallest hashes and grows in its own task.
    """
    usable = rows.select(key, vector).where(F.col(vector).isNotNull())
    n = usable.count()
    share = min(1.0, (sample + 10.0 * sample**0.5 + 100.0) / max(n, 1))
    luck = lambda tree: F.pmod(F.xxhash64(F.lit(seed), tree, F.col(key)), F.lit(2**32))
    every = F.sequence(F.lit(0), F.lit(trees - 1))
    hits = F.filter(every, lambda t: luck(t) <= F.lit(int(share * 2**32)))
    drawn = (
        usable.withColumn("tree", F.explode(hits))
        .withColumn("__h", luck(F.col("tree")))
        .withColumn("__i", F.row_number().over(W.partitionBy("tree").orderBy("__h", key)))
        .where(F.col("__i") <= sample)
        .select("tree", "__i", vector)
    )

    def one_tree(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iat[0])
        points = np.stack(pdf.sort_values("__i")[vector]).astype(float)
        limit = max(1, math.ceil(math.log2(max(len(points), 2))))
        nodes = _grow(points, np.random.default_rng([seed, tree]), limit)
        names = ["node", "feature", "threshold", "left", "right", "depth", "size"]
        out = pd.DataFrame(nodes, columns=names)
        out.insert(0, "tree", tree)
        return out

    return drawn.groupBy("tree").applyInPandas(one_tree, NODE_SCHEMA)


def pack_forest(forest: DataFrame) -> dict:
    """The node table as arrays for a vectorised walk.

    It has at most ``trees * (2 * sample - 1)`` rows whatever the data.
    """
    nodes = forest.orderBy("tree", "node").toArrow()
    get = lambda name: nodes.column(name).to_numpy()
    tree = get("tree")
    starts = np.flatnonzero(np.r_[True, tree[1:] != tree[:-1]]) if len(tree) else np.empty(0, int)
    sizes = get("size")
    base = np.repeat(starts, np.diff(np.r_[starts, len(tree)]))
    return {
        "roots": starts,
        "feature": get("feature"),
        "threshold": get("threshold"),
        "left": get("left") + base,
        "right": get("right") + base,
        "size": sizes,
        "length": get("depth") + average_path(sizes),
        "scale": float(average_path(sizes[starts]).mean()) if len(starts) else 0.0,
    }


def walk_forest(x: np.ndarray, f: dict) -> np.ndarray:
    """``-2 ** (-mean depth / c(sample))`` of every row of a matrix."""
    everyone = np.arange(len(x))
    total = np.zeros(len(x))
    for root in f["roots"]:
        at = np.full(len(x), root)
        while True:
            inner = f["feature"][at] >= 0
            if not inner.any():
                break
            who, here = everyone[inner], at[inner]
            low = x[who, f["feature"][here]] <= f["threshold"][here]
            at[inner] = np.where(low, f["left"][here], f["right"][here])
        total += f["length"][at]
    mean = total / max(len(f["roots"]), 1)
    return -np.exp2(-mean / max(f["scale"], 1e-12))


def raw_scores(rows: DataFrame, forest: DataFrame, vector: str, into: str = "score") -> DataFrame:
    """Add ``-2 ** (-mean depth / c(sample))``, closer to -1 the more anomalous; NULL for
    a NULL vector.  The size of the broadcast forest is bounded by its parameters."""
    packed = rows.sparkSession.sparkContext.broadcast(pack_forest(forest))

    @F.arrow_udf("double")
    def walk(column: pa.Array) -> pa.Array:
        given = np.asarray(column.is_valid())
        out = np.full(len(given), np.nan)
        out[given] = walk_forest(rows_as_matrix(column.filter(pa.array(given))), packed.value)
        return pa.array(out, mask=~given)

    return rows.withColumn(into, walk(F.col(vector)))


def forest_offset(
    train: DataFrame, forest: DataFrame, vector: str, contamination: float = CONTAMINATION
) -> DataFrame:
    """Score below which the most anomalous share of the training rows falls."""
    scored = settle(raw_scores(train.select(vector), forest, vector).select("score"), "scores")
    return exact_quantiles(scored, [], "score", {"offset": contamination}).select("offset")


def decide(scored: DataFrame, offset: DataFrame) -> DataFrame:
    """Add ``decision`` (negative means anomalous) and the +-1 label ``flag``."""
    at = settle(offset, "offset").scalar()
    return scored.withColumn("decision", F.col("score") - at).withColumn(
        "flag", F.when(F.col("decision") < 0, -1).otherwise(1)
    )


def flag_stats(decided: DataFrame) -> DataFrame:
    return decided.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("flag") == -1).alias("flagged"),
        (F.avg((F.col("flag") == -1).cast("double")) * 100).alias("flagged_pct"),
        F.min("decision").alias("min_decision"),
        F.max("decision").alias("max_decision"),
    )
