"""Vector matching against reference sites and cluster centres.

A packed reference matrix that is small enough is broadcast
whole; its size is checked first.  Beyond the limit the patches are dealt once into buckets
that a task can hold, and the sites stream past each bucket chunk by chunk, as many at a time
as the limit allows.  Chunks hold sites that point the same way, and an angle (or distance)
bound skips those that cannot improve a patch's matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scalars import shift_cosine
from ..session import attach_small, settle

# Epsilon added to vector lengths by the two scoring variants.
EPS_OFFLINE = 1e-10
EPS_ONLINE = 1e-8

MAX_BROADCAST_BYTES = 64 * 1024 * 1024
BLOCK_ROWS = 4096
# Sites that chunks of sites are gathered around, at most.
MAX_PIVOTS = 1024
# Scores that a task holds at a time, and the sites they are for.
TILE_CELLS = 1 << 20
TILE_SITES = 2048
# Bytes of the vectors of a bucket of patches that sites stream past.
BUCKET_BYTES = 16 * 1024 * 1024
# Chunks of sites that a bucket is compared with at a time, at most.
MAX_CHUNKS = 64
# Matrices are padded to multiples of this before they are multiplied, so that equal vectors
# score alike wherever they lie and ties go by the index.
PADDING = 16


def rows_as_matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix, without Python objects.

    A NULL list becomes a row of NaN.  Lists of other lengths than ``width`` (by default
    that of the first list) raise.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("float64", copy=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    given = ~np.asarray(column.is_null())
    if width is None:
        width = int(lengths[given][0]) if given.any() else 0
    if (lengths[given] != width).any():
        raise ValueError(f"vectors of other lengths than {width}")
    if given.all():
        return flat.reshape(len(column), width)
    out = np.full((len(column), width), np.nan)
    out[given] = flat.reshape(-1, width)
    return out


def matrix_as_rows(matrix: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    """The inverse: one list per matrix row, NULL where ``missing``."""
    offsets = np.arange(len(matrix) + 1, dtype="int32") * (matrix.shape[1] if len(matrix) else 0)
    mask = None if missing is None or not missing.any() else pa.array(missing)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.ravel()), mask=mask)


def _unit(matrix: np.ndarray, eps: float) -> np.ndarray:
    return matrix / (np.sqrt((matrix * matrix).sum(axis=1, keepdims=True)) + eps)


def _score(x: np.ndarray, ref: np.ndarray, metric: str, eps: float) -> np.ndarray:
    """Larger is better: cosine, or negated distance."""
    if metric == "cosine":
        return _unit(x, eps) @ _unit(ref, eps).T
    # One reference row at a time: no cancellation, no N x K x D temporary.
    return np.stack([-np.sqrt(((x - row) ** 2).sum(axis=1)) for row in ref], axis=1)


def _padded(matrix: np.ndarray) -> np.ndarray:
    """The matrix with rows of zeros up to a multiple of ``PADDING``."""
    missing = -len(matrix) % PADDING
    return np.pad(matrix, ((0, missing), (0, 0))) if missing else matrix


def _cosines(x: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Cosines of unit vectors."""
    return (_padded(x) @ _padded(ref).T)[: len(x), : len(ref)]


def _tiles(x: np.ndarray, ref: np.ndarray, metric: str):
    """``(first row, first site, scores)`` of bounded tiles; cosines are those of unit vectors.

    A row's tiles come one after the other, in order of the sites.
    """
    tall = max(PADDING, TILE_CELLS // max(1, min(len(ref), TILE_SITES)))
    for row in range(0, len(x), tall):
        some = x[row : row + tall]
        for site in range(0, len(ref), TILE_SITES):
            part = ref[site : site + TILE_SITES]
            if metric == "cosine":
                yield row, site, _cosines(some, part)
            else:
                yield row, site, _score(some, part, metric, 0.0)


def _best_of(x: np.ndarray, ref: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Position and score of each row's best site, the first of equals; NaN if any is NaN."""
    at, top = np.zeros(len(x), dtype=np.int64), np.full(len(x), -np.inf)
    for row, site, scores in _tiles(x, ref, metric):
        here = scores.argmax(axis=1)
        found = scores[np.arange(len(here)), here]
        own, where = top[row : row + len(here)], at[row : row + len(here)]
        better = (found > own) | np.isnan(found)
        where[better] = here[better] + site
        # NaN stays NaN.
        np.maximum(own, found, out=own)
    return at, top


def _firsts(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of the ``k`` largest scores of each row, best first, the first of equals."""
    if k > 16:
        at = np.argsort(-scores, axis=1, kind="stable")[:, :k]
        return at, np.take_along_axis(scores, at, axis=1)
    scores, rows = scores.copy(), np.arange(len(scores))
    at = np.empty((len(scores), min(k, scores.shape[1])), dtype=np.int64)
    top = np.empty(at.shape)
    for j in range(at.shape[1]):
        at[:, j] = scores.argmax(axis=1)
        top[:, j] = scores[rows, at[:, j]]
        scores[rows, at[:, j]] = -np.inf
    return at, top


def _top_of(x: np.ndarray, ref: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and cosines of each row's ``k`` best sites, best first; NaN for none."""
    k = min(k, len(ref))
    at, top = np.zeros((len(x), k), dtype=np.int64), np.full((len(x), k), -np.inf)
    for row, site, scores in _tiles(x, ref, "cosine"):
        scores[np.isnan(scores)] = -np.inf
        rows = slice(row, row + len(scores))
        near = np.flatnonzero(scores.max(axis=1) > top[rows, -1])
        if not len(near):
            continue
        here, found = _firsts(scores[near], k)
        both = np.concatenate((top[rows][near], found), axis=1)
        names = np.concatenate((at[rows][near], here + site), axis=1)
        # Sites known so far come first and have lower positions.
        order = np.argsort(-both, axis=1, kind="stable")[:, :k]
        top[rows][near] = np.take_along_axis(both, order, axis=1)
        at[rows][near] = np.take_along_axis(names, order, axis=1)
    return at, np.where(np.isneginf(top), np.nan, top)


def number_sites(sites: DataFrame, order: str) -> DataFrame:
    """0-based ``site_idx`` in the order of a unique key, counted per range block."""
    from ..functions.ranking import ordinal_by_line

    lines = sites.withColumn("__all", F.lit(0)).withColumn(
        "__line", F.floor(F.col(order) / F.lit(10_000.0))
    )
    return ordinal_by_line(lines, "__all", "__line", order, "site_idx").drop("__all", "__line")


def best_match(
    patches: DataFrame,
    sites: DataFrame,
    key: str,
    vector: str = "embedding",
    site_vector: str = "embedding",
    site_key: str = "site_idx",
    metric: str = "cosine",
    eps: float = EPS_OFFLINE,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(key, best_idx, best)`` per patch; ties go to the lowest site index.

    ``best`` is the largest cosine, or for ``metric='euclidean'`` the smallest
    distance.  Exact whatever the number of sites.  Every row of ``patches`` gives one row,
    repeated keys included; a NULL vector, or one with NULL or NaN cells, has no match.
    Vectors of another length than the sites' raise.
    """
    m = _best_match(
        patches, sites, key, vector, site_vector, site_key, metric, eps,
        max_broadcast_bytes, block_rows,
    )
    found = ~F.isnan("best")
    return m.select(
        key, F.when(found, F.col("best_idx")).alias("best_idx"),
        F.when(found, F.col("best")).alias("best"),
    )


def _best_match(
    patches, sites, key, vector, site_vector, site_key, metric, eps,
    max_broadcast_bytes, block_rows,
):
    size = sites.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size(site_vector)).alias("d")
    ).first()
    n_sites, dim = size["n"], size["d"] or 0
    sign = 1.0 if metric == "cosine" else -1.0
    if n_sites == 0:
        none = F.lit(None)
        return patches.select(
            key, none.cast("long").alias("best_idx"), none.cast("double").alias("best")
        )
    if n_sites * dim * 8 <= max_broadcast_bytes:
        return _match_broadcast(patches, sites, key, vector, site_vector, site_key, metric, eps, sign)
    walked = _walk_sites(
        patches, sites, key, vector, site_vector, site_key, metric, eps, 1, n_sites, dim,
        max_broadcast_bytes, block_rows,
    )
    best, at = F.get("top", F.lit(0)), F.get("ids", F.lit(0))
    return walked.select(key, at.alias("best_idx"), (best * sign).alias("best"))


def _match_broadcast(patches, sites, key, vector, site_vector, site_key, metric, eps, sign):
    spark = patches.sparkSession
    table = sites.select(F.col(site_key).cast("long").alias("k"), site_vector).orderBy("k").toArrow()
    held = rows_as_matrix(table.column(site_vector))
    packed = spark.sparkContext.broadcast(
        (table.column("k").to_numpy(), _unit(held, eps) if metric == "cosine" else held)
    )
    out = "struct<best_idx: bigint, best: double>"

    @F.arrow_udf(out)
    def match(column: pa.Array) -> pa.Array:
        ids, ref = packed.value
        x = rows_as_matrix(column, ref.shape[1])
        at, top = _best_of(_unit(x, eps) if metric == "cosine" else x, ref, metric)
        return pa.StructArray.from_arrays(
            [pa.array(ids[at], pa.int64()), pa.array(top * sign, pa.float64())],
            ["best_idx", "best"],
        )

    return patches.select(key, match(F.col(vector)).alias("m")).select(key, "m.best_idx", "m.best")


@dataclass
class _Chunk:
    """Some sites that lie close together, in order of their index."""

    ids: np.ndarray
    sites: np.ndarray
    centre: np.ndarray
    reach: float  # largest angle, or distance, of a site from the centre


def _chunk(ids: np.ndarray, sites: np.ndarray, metric: str) -> _Chunk:
    if metric == "cosine":
        unit = _unit(sites, 1e-300)
        centre = _unit(unit.mean(axis=0, keepdims=True), 1e-300)[0]
        reach = float(np.arccos(np.clip(unit @ centre, -1.0, 1.0)).max())
    else:
        centre = sites.mean(axis=0)
        reach = float(np.sqrt(((sites - centre) ** 2).sum(axis=1)).max())
    return _Chunk(ids, sites, centre, reach)


# Slack of the bounds, well above the rounding of a cosine or a distance.
_SLACK = 1e-6


def _bounds(x: np.ndarray, chunks: list[_Chunk], metric: str) -> np.ndarray:
    """No site of a chunk scores more than its column; ``x`` are unit vectors for cosines."""
    centres = np.stack([c.centre for c in chunks])
    reach = np.array([c.reach for c in chunks])
    if metric == "cosine":
        angle = np.arccos(np.clip(x @ centres.T, -1.0, 1.0))
        # The epsilon in a length moves a cosine towards 0, so a negative bound becomes 0.
        return np.maximum(np.cos(np.maximum(angle - reach, 0.0)), 0.0) + _SLACK
    away = -_score(x, centres, metric, 0.0)
    return -np.maximum(away - reach, 0.0) * (1.0 - _SLACK) + _SLACK


class _Bucket:
    """Some patches and the ``k`` best sites of each so far, best first, ties by index."""

    def __init__(self, keys: list[pa.Array], vectors: list[np.ndarray], metric, eps, k):
        self.keys, self.metric, self.eps = pa.concat_arrays(keys), metric, eps
        x = np.concatenate(vectors)
        self.top, self.ids = np.full((len(x), k), -np.inf), np.full((len(x), k), 2**62)
        self.good = np.flatnonzero(np.isfinite(x).all(axis=1))
        x = x[self.good]
        # Vectors for the scores and for the bounds.
        self.x = _unit(x, eps) if metric == "cosine" else x
        self.plain = _unit(x, 1e-300) if metric == "cosine" else x

    def meet(self, chunks: list[_Chunk]) -> None:
        """Take the sites of some chunks into account."""
        if not len(self.good):
            return
        bounds = _bounds(self.plain, chunks, self.metric)
        near = (bounds >= self.top[self.good, -1:]).any(axis=0)
        for part in _grouped(np.flatnonzero(near).tolist(), chunks):
            self._take([chunks[i] for i in part], bounds[:, part])

    def _take(self, chunks: list[_Chunk], bounds: np.ndarray) -> None:
        rows = np.flatnonzero((bounds >= self.top[self.good, -1:]).any(axis=1))
        if not len(rows):
            return
        ids = np.concatenate([c.ids for c in chunks])
        order = np.argsort(ids, kind="stable")
        ids, ref = ids[order], np.concatenate([c.sites for c in chunks])[order]
        ref = _unit(ref, self.eps) if self.metric == "cosine" else ref
        x = self.x if len(rows) == len(self.x) else self.x[rows]
        own, k = self.good[rows], self.top.shape[1]
        if k == 1:
            at, found = _best_of(x, ref, self.metric)
            names, was = ids[at], self.top[own, 0]
            better = (found > was) | ((found == was) & (names < self.ids[own, 0]))
            self.top[own[better], 0], self.ids[own[better], 0] = found[better], names[better]
            return
        at, found = _top_of(x, ref, k)
        both = np.concatenate((self.top[own], np.nan_to_num(found, nan=-np.inf)), axis=1)
        names = np.concatenate((self.ids[own], ids[at]), axis=1)
        order = np.lexsort((names, -both), axis=1)[:, :k]
        self.top[own] = np.take_along_axis(both, order, axis=1)
        self.ids[own] = np.take_along_axis(names, order, axis=1)

    def rows(self, schema: pa.Schema) -> pa.RecordBatch:
        arrays = [self.keys, matrix_as_rows(self.top), matrix_as_rows(self.ids)]
        return pa.RecordBatch.from_arrays(
            [a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema
        )


def _grouped(numbers: list[int], chunks: list[_Chunk]) -> list[list[int]]:
    """Neighbouring chunks that are scored together, a few hundred sites or one chunk."""
    out, size = [], 0
    for i in numbers:
        if not out or size + len(chunks[i].ids) > 512:
            out.append([])
            size = 0
        out[-1].append(i)
        size += len(chunks[i].ids)
    return out


def _dealt_sites(sites, site_vector, site_key, metric, n_sites, block_rows) -> DataFrame:
    """Rows ``(chunk, idx, ref)``: every site with the number of its chunk.

    Sites go to the nearest of a bounded number of drawn sites; more than ``block_rows`` of
    them are split by hash.
    """
    spark = sites.sparkSession
    rows = sites.select(
        F.col(site_key).cast("long").alias("idx"), F.col(site_vector).alias("ref")
    )
    pivots = min(MAX_PIVOTS, -(-n_sites // block_rows))
    drawn = rows.orderBy(F.xxhash64("idx"), "idx").limit(pivots).toArrow()
    drawn = rows_as_matrix(drawn.column("ref"))
    held = spark.sparkContext.broadcast(_unit(drawn, 1e-300) if metric == "cosine" else drawn)

    @F.arrow_udf("int")
    def nearest(column: pa.Array) -> pa.Array:
        x = rows_as_matrix(column, held.value.shape[1])
        x = _unit(x, 1e-300) if metric == "cosine" else x
        out = np.zeros(len(x), dtype=np.int32)
        # The pivots fit into the width of one tile.
        for row, _, scores in _tiles(x, held.value, metric):
            out[row : row + len(scores)] = np.nan_to_num(scores, nan=-np.inf).argmax(axis=1)
        return pa.array(out)

    near = settle(rows.withColumn("pivot", nearest("ref")), "sites")
    counts = near.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(float(block_rows))).cast("int")
    split = attach_small(near, counts.select("pivot", parts.alias("parts")), ["pivot"], "inner")
    part = F.pmod(F.xxhash64("idx"), F.col("parts")).cast("long")
    # The number is the pivot and the part in it.
    split = split.withColumn("chunk", F.col("pivot").cast("long") * F.lit(1 << 20) + part)
    return settle(split.select("chunk", "idx", "ref"), "chunks")


def _walk_sites(
    patches, sites, key, vector, site_vector, site_key, metric, eps, k, n_sites, dim,
    max_broadcast_bytes, block_rows,
):
    """Rows ``(key, top, ids)``: scores and indices of the ``k`` best sites of each patch.

    The patches are shuffled once, and the sites once for every bucket of patches.
    """
    chunks = _dealt_sites(sites, site_vector, site_key, metric, n_sites, block_rows)
    at_once = min(MAX_CHUNKS, max(1, max_broadcast_bytes // (block_rows * dim * 8)))
    held = settle(patches.select(F.col(key).alias("k"), F.col(vector).alias("vec")), "vectors")
    cores = patches.sparkSession.sparkContext.defaultParallelism
    # A few buckets for every core, all of them bounded.
    buckets = cores * max(1, -(-held.count() * dim * 8 // (BUCKET_BYTES * cores)))
    none = F.lit(None)
    dealt = held.select(
        F.pmod(F.monotonically_increasing_id(), F.lit(buckets)).cast("int").alias("bucket"),
        F.lit(-1).cast("long").alias("chunk"), none.cast("long").alias("idx"), "k",
        F.col("vec").cast("array<double>").alias("vec"),
    )
    passing = chunks.select(
        F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), "chunk", "idx",
        none.cast(held.schema["k"].dataType).alias("k"),
        F.col("ref").cast("array<double>").alias("vec"),
    )
    stream = dealt.unionByName(passing).repartitionById(buckets, "bucket")
    stream = stream.sortWithinPartitions("bucket", "chunk", "idx")
    lists = T.StructType.fromDDL("top array<double>, ids array<bigint>")
    schema = T.StructType([T.StructField(key, held.schema["k"].dataType), *lists])
    names = to_arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vectors, bucket, at = [], [], None, None
        chunk, ids, refs, ready = None, [], [], []

        def close():
            if ids:
                ready.append(_chunk(np.concatenate(ids), np.concatenate(refs), metric))
                ids.clear()
                refs.clear()

        def finish():
            close()
            done = bucket or (_Bucket(keys, vectors, metric, eps, k) if keys else None)
            if done is not None:
                if ready:
                    done.meet(ready)
                yield done.rows(names)

        for batch in batches:
            if not batch.num_rows:
                continue
            owner, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            x, index = rows_as_matrix(batch.column(4), dim), batch.column(2)
            starts = np.flatnonzero((np.diff(owner) != 0) | (np.diff(number) != 0)) + 1
            starts = [0, *starts.tolist(), len(owner)]
            for a, b in zip(starts, starts[1:]):
                if owner[a] != at:
                    yield from finish()
                    keys, vectors, bucket, at, ready = [], [], None, owner[a], []
                if number[a] < 0:
                    keys.append(batch.column(3).slice(a, b - a))
                    vectors.append(x[a:b])
                    continue
                if not keys:
                    continue
                bucket = bucket or _Bucket(keys, vectors, metric, eps, k)
                vectors = []
                if number[a] != chunk:
                    close()
                    chunk = number[a]
                    if len(ready) >= at_once:
                        bucket.meet(ready)
                        ready = []
                ids.append(index.slice(a, b - a).to_numpy(zero_copy_only=False).astype(np.int64))
                refs.append(x[a:b])
        yield from finish()

    carried = settle(stream.mapInArrow(walk, schema), "carried")
    cut = F.filter("top", lambda v: v > float("-inf"))
    return carried.select(key, cut.alias("top"), F.slice("ids", F.lit(1), F.size(cut)).alias("ids"))


# ---- named scores ----------------------------------------------------------


def site_similarity(
    patches: DataFrame, sites: DataFrame, key: str, variant: str = "offline", **kw
) -> DataFrame:
    """Best cosine against known sites.

    ``offline`` reports ``(max + 1) / 2``; ``online`` the raw maximum, 0 without
    any reference site.  Adds ``max_similarity``, ``best_idx`` and ``arch_similarity``.
    """
    eps = {"offline": EPS_OFFLINE, "online": EPS_ONLINE}[variant]
    m = best_match(patches, sites, key, eps=eps, **kw)
    score = shift_cosine(F.col("best")) if variant == "offline" else F.coalesce("best", F.lit(0.0))
    return m.select(
        key, "best_idx", F.col("best").alias("max_similarity"), score.alias("arch_similarity")
    )


def cluster_cosine(patches: DataFrame, centroids: DataFrame, key: str, **kw) -> DataFrame:
    """Offline cluster score: best shifted cosine and the cluster reaching it."""
    m = best_match(patches, centroids, key, site_key="cluster", **kw)
    return m.select(
        key, F.col("best_idx").alias("cluster"), shift_cosine(F.col("best")).alias("prob_kmeans")
    )


def cluster_distance(patches: DataFrame, centroids: DataFrame, key: str, **kw) -> DataFrame:
    """Online cluster score: 1 - nearest distance / largest centroid distance."""
    m = best_match(patches, centroids, key, site_key="cluster", metric="euclidean", **kw)
    spread = centroid_spread(centroids).scalar()
    return m.select(
        key,
        F.col("best_idx").alias("cluster"),
        (1.0 - F.col("best") / F.nullif(spread, F.lit(0.0))).alias("prob_kmeans"),
    )


def centroid_spread(centroids: DataFrame, vector: str = "embedding") -> DataFrame:
    """Largest distance between two centroids, as a single value.

    The centroid list is a model parameter of fixed length (its ``k``), so its
    pairs are formed inside one array expression.
    """
    packed = centroids.agg(F.collect_list(vector).alias("cs"))

    def distance(a: Column, b: Column) -> Column:
        return F.sqrt(
            F.aggregate(
                F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
            )
        )

    pairs = F.transform(
        "cs", lambda a: F.array_max(F.transform("cs", lambda b: distance(a, b)))
    )
    return packed.select(F.array_max(pairs).alias("spread"))


def mean_vectors(rows: DataFrame, group: str, vector: str, out: str = "embedding") -> DataFrame:
    """Mean vector per group, element by element."""
    per_cell = (
        rows.select(group, F.posexplode(vector).alias("pos", "x"))
        .groupBy(group, "pos")
        .agg(F.avg(F.col("x").cast("double")).alias("x"))
    )
    in_order = F.array_sort(F.collect_list(F.struct("pos", "x")))
    return per_cell.groupBy(group).agg(F.transform(in_order, lambda s: s["x"]).alias(out))


def name_best_site(matches: DataFrame, sites: DataFrame) -> DataFrame:
    """Look up area and patch of the best site; the optimizer sizes the join."""
    names = sites.select(
        F.col("site_idx").alias("best_idx"),
        F.col("aoi").alias("site_aoi"),
        F.col("patch_id").alias("site_patch_id"),
    )
    return matches.join(names, "best_idx", "left")


def site_match_counts(matches: DataFrame, top: int | None = 5) -> DataFrame:
    """How often each site is the best match, with its share in percent."""
    total = matches.agg(F.count(F.lit(1)).alias("n")).scalar()
    out = matches.groupBy("best_idx").agg(F.count(F.lit(1)).alias("patches")).withColumn(
        "share_pct", F.col("patches") / F.nullif(total, F.lit(0)) * 100.0
    )
    if top is None:
        return out
    return out.orderBy(F.desc("patches"), "best_idx").limit(top)


def top_k_similar(matches: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` patches closest to any known site."""
    return matches.orderBy(F.desc("max_similarity"), "vec_id").limit(k)


def top_matches(
    patches: DataFrame,
    sites: DataFrame,
    key: str,
    k: int,
    vector: str = "embedding",
    eps: float = EPS_OFFLINE,
    max_broadcast_bytes: int = MAX_BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """The ``k`` most similar sites per patch as rows ``(key, rank, site_idx, similarity)``.

    Same two ways as ``best_match``; a patch carries its ``k`` best sites from pass to pass.
    Patches without a usable vector have no rows.
    """
    size = sites.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("d")).first()
    if size["n"] * (size["d"] or 0) * 8 <= max_broadcast_bytes:
        found = _top_of_broadcast(patches, sites, key, k, vector, eps)
    else:
        walked = _walk_sites(
            patches, sites, key, vector, "embedding", "site_idx", "cosine", eps, k, size["n"],
            size["d"], max_broadcast_bytes, block_rows,
        )
        cells = F.transform(
            F.arrays_zip("top", "ids"), lambda c: F.struct(c["top"].alias("s"), c["ids"].alias("i"))
        )
        found = walked.select(key, cells.alias("m"))
    cells = found.select(key, F.posexplode("m").alias("pos", "m"))
    return cells.where(~F.isnan("m.s")).select(
        key,
        (F.col("pos") + 1).alias("rank"),
        F.col("m.i").alias("site_idx"),
        F.col("m.s").alias("similarity"),
    )


def _top_of_broadcast(patches, sites, key, k, vector, eps):
    table = (
        sites.select(F.col("site_idx").cast("long").alias("k"), "embedding").orderBy("k").toArrow()
    )
    ids = table.column("k").to_numpy()
    packed = patches.sparkSession.sparkContext.broadcast(
        (ids, _unit(rows_as_matrix(table.column("embedding")), eps))
    )

    @F.arrow_udf("array<struct<s: double, i: bigint>>")
    def match(column: pa.Array) -> pa.Array:
        site_ids, ref = packed.value
        x = rows_as_matrix(column, ref.shape[1])
        at, top = _top_of(_unit(x, eps), ref, k)
        cells = pa.StructArray.from_arrays(
            [pa.array(top.ravel()), pa.array(site_ids[at].ravel())], ["s", "i"]
        )
        offsets = pa.array(np.arange(len(at) + 1, dtype="int32") * at.shape[1])
        return pa.ListArray.from_arrays(offsets, cells)

    return patches.select(key, match(F.col(vector)).alias("m"))
