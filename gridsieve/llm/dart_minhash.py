"""Near-duplicate classes from DartMinHash signatures, banded joining and an exact check."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.components import components
from gridsieve.llm.memory import giving_back
from gridsieve.llm.shingles import mix, shingles, words_of
from gridsieve.session import settle

SHINGLE = 5
SIMILARITY = 0.8
# 32 bands of 4: a pair at 0.8 shares no band once in 20 million.
BANDS, ROWS = 32, 4
COORDINATES = BANDS * ROWS
# Shingles whose darts are thrown at a time.
CHUNK = 100_000
# Buckets of up to so many texts pair all unconnected texts at once.  Larger ones try the
# centres first, then compare what is still unconnected block by block.
SMALL_BUCKET = 32
CENTRES = 4
# Texts, and elements of their sets, in one side of a block pair, on average.
BLOCK_TEXTS, BLOCK_ELEMENTS = 512, 1_000_000
# Elements counted at a time for a block pair.
COLUMNS = 4096

# Cumulative Poisson(1) probabilities: darts in a cell of unit area.
_DARTS = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(18)])
_DARTS = np.array([min(int(p * 2.0**64), 2**64 - 1) for p in _DARTS], dtype=np.uint64)
_A, _B, _C = (np.uint64(c) for c in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def signatures(
    sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES, spread: float = 4.0
) -> np.ndarray:
    """DartMinHash signatures of weighted sets (element hashes, positive weights).

    Each element owns an endless plane of (weight, rank) with one dart in a unit cell on
    average, all placed by hashing the element and the cell.  A set sees the darts below its
    weights; those of low rank are thrown, about k (ln k + spread) of them however many
    elements there are.  A dart names one of ``k`` coordinates, and the earliest rank wins.
    Two sets agree in a coordinate with the probability of their weighted Jaccard
    similarity.  A set with an empty coordinate is thrown again up to twice the rank.
    An empty set has zeros.
    """
    out = np.zeros((len(sets), k), dtype=np.uint64)
    todo = [i for i, (h, _) in enumerate(sets) if len(h)]
    darts = k * (math.log(k) + spread)
    while todo:
        filled = np.zeros((len(sets), k), dtype=bool)
        at = 0
        while at < len(todo):
            some, size = [], 0
            while at < len(todo) and (not some or size < CHUNK):
                some.append(todo[at])
                size += len(sets[todo[at]][0])
                at += 1
            _throw(sets, some, darts, k, out, filled)
        todo = [i for i in todo if not filled[i].all()]
        darts *= 2
    return out


def _throw(sets, some: list[int], darts: float, k: int, out: np.ndarray, filled: np.ndarray):
    hashes = np.concatenate([sets[i][0] for i in some])
    weights = np.concatenate([sets[i][1] for i in some]).astype(np.float64)
    sizes = np.array([len(sets[i][0]) for i in some])
    totals = np.add.reduceat(weights, np.cumsum(sizes) - sizes)
    reach = np.repeat(darts / totals, sizes)
    owner = np.repeat(np.array(some, dtype=np.int64), sizes)
    ranks = np.ceil(reach).astype(np.int64)
    cells = np.ceil(weights).astype(np.int64) * ranks
    element = np.repeat(np.arange(len(hashes)), cells)
    cell = np.arange(len(element)) - np.repeat(np.cumsum(cells) - cells, cells)
    high, right = np.divmod(cell, ranks[element])
    place = high.astype(np.uint64) * _A + right.astype(np.uint64) * _B + _C
    seeds = mix(hashes[element] ^ mix(place))
    count = np.searchsorted(_DARTS, seeds, side="right")
    slots, order_by, names = [], [], []
    for m in range(int(count.max(initial=0))):
        here = np.flatnonzero(count > m)
        dart = mix(seeds[here] + np.uint64((m + 1) * int(_B) % 2**64))
        rank = right[here] + _unit(dart)
        other = mix(dart + _C)
        own = element[here]
        low = (rank < reach[own]) & (high[here] + _unit(mix(other)) < weights[own])
        coordinate = (other[low] % np.uint64(k)).astype(np.int64)
        slots.append(owner[own[low]] * k + coordinate)
        order_by.append(rank[low])
        names.append(mix(other[low] ^ _A))
    slot, rank, name = (np.concatenate(x) for x in (slots, order_by, names))
    order = np.argsort(-rank, kind="stable")
    # The last write of a coordinate stays, which is its earliest rank.
    out.reshape(-1)[slot[order]] = name[order]
    filled.reshape(-1)[slot] = True


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key for each band of each row."""
    parts = signature.reshape(len(signature), bands, -1)
    out = mix(np.arange(1, bands + 1, dtype=np.uint64) * _C)[None, :] + np.zeros(
        (len(signature), 1), dtype=np.uint64
    )
    for r in range(parts.shape[2]):
        out = mix(out * _B + parts[:, :, r])
    return out


def weighted_set(text: str | None, size: int, counted: bool) -> tuple[np.ndarray, np.ndarray]:
    own, counts = np.unique(shingles(text, size), return_counts=True)
    return own, counts.astype(np.float64) if counted else np.ones(len(own))


def _named(doc: int | None, text: str | None) -> tuple[int, bytes]:
    """(node, digest of the words): the id, or a negative number made of the digest."""
    digest = hashlib.blake2b(b" ".join(words_of(text)), digest_size=16).digest()
    return (-1 - int.from_bytes(digest[:7], "little") if doc is None else doc), digest


def _described(docs: DataFrame, size: int, counted: bool) -> DataFrame:
    """(node, digest, bands) of every row of (doc_id, text); bands are empty without words."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                digests, sets, nodes = [], [], []
                for doc, text in zip(ids, texts):
                    node, digest = _named(doc, text)
                    nodes.append(node)
                    digests.append(digest)
                    sets.append(weighted_set(text, size, counted))
                keys = band_hashes(signatures(sets)).astype(np.int64)
                bands = [b if len(s[0]) else [] for b, s in zip(keys, sets)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()),
                        pa.array(nodes, pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "node", "digest", "bands"],
                )

    schema = "doc_id bigint, node bigint, digest binary, bands array<bigint>"
    return docs.mapInArrow(giving_back(describe), schema)


def _elements(docs: DataFrame, size: int, counted: bool) -> DataFrame:
    """(node, digest, own) with the distinct 32-bit hashes of a text's elements, for the exact check.

    Counted shingles become one element for each occurrence, so that the plain Jaccard of
    these sets is the weighted Jaccard of the texts.
    """

    def list_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, texts = (c.to_pylist() for c in batch.slice(at, 256).columns)
                named, sets = list(map(_named, ids, texts)), []
                for text in texts:
                    own, counts = weighted_set(text, size, counted)
                    if counted:
                        times = counts.astype(np.int64)
                        first = np.repeat(np.cumsum(times) - times, times)
                        nth = (np.arange(len(first)) - first).astype(np.uint64)
                        own = mix(np.repeat(own, times) + nth * _A)
                    sets.append(np.unique(own.astype(np.uint32)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([n for n, _ in named], pa.int64()),
                        pa.array([d for _, d in named], pa.binary()),
                        pa.array(sets, pa.list_(pa.int32())),
                    ],
                    ["node", "digest", "own"],
                )

    return docs.mapInArrow(giving_back(list_), "node bigint, digest binary, own array<int>")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact similarity reaches the limit."""
    left = sets.select(F.col("node").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("node").alias("b"), F.col("own").alias("own_b"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("own_a", "own_b"))
    union = F.size("own_a") + F.size("own_b") - common
    return both.where(common >= similarity * union - 1e-9).select("a", "b").distinct()


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``."""
    values = [np.concatenate(side) for side in (left, right)]
    owners = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    both = np.intersect1d(*values)
    places = []
    for k, v in enumerate(values):
        at = np.searchsorted(both, v)
        held = np.flatnonzero(at < len(both))
        held = held[both[at[held]] == v[held]]
        order = np.argsort(at[held], kind="stable")
        places.append((at[held][order], owners[k][held][order]))
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    for first in range(0, len(both), COLUMNS):
        parts = []
        for (at, owner), side in zip(places, (left, right)):
            x, y = np.searchsorted(at, [first, first + COLUMNS])
            part = np.zeros((len(side), min(COLUMNS, len(both) - first)), dtype=np.float32)
            part[owner[x:y], at[x:y] - first] = 1
            parts.append(part)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def _spanning_links(table: pa.Table, similarity: float) -> list[tuple[int, int]]:
    """Links between the two sides of a block pair that join all labels its similar pairs join."""
    side = np.array(table.column("side"))
    label, node = np.array(table.column("label")), np.array(table.column("node"))
    own = table.column("own").combine_chunks()
    # Sides: 0 left, 1 right, 2 both.
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right):
        return []
    ends, values = np.array(own.offsets), np.array(own.values)
    sets = lambda rows: [values[ends[i] : ends[i + 1]] for i in rows]
    common = _common(sets(left), sets(right))
    sizes = np.diff(ends)
    union = sizes[left][:, None] + sizes[right][None, :] - common
    hit = (common >= similarity * union - 1e-9) & (label[left][:, None] != label[right][None, :])
    a, b = np.nonzero(hit)
    a, b = left[a], right[b]
    _, once = np.unique(np.stack([label[a], label[b]]), axis=1, return_index=True)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(a[once], b[once]):
        x, y = find(int(label[i])), find(int(label[j]))
        if x != y:
            root[x] = y
            out.append((int(node[i]), int(node[j])))
    return out


def _block_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) that join all components with a similar pair in a bucket.

    ``members`` are (h, node, label) of buckets with several components.  In each bucket the
    texts outside its largest component are dealt to blocks, and so are those inside.  Every
    outer block meets every block in its own task, so every pair of different components is
    compared by its whole sets, and a task's size does not grow with the bucket.
    """
    sized = members.join(sets.select("node", F.size("own").alias("n")), "node")
    counts = sized.groupBy("h", "label").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    blocks = lambda m, n: F.greatest(
        F.ceil(m / BLOCK_TEXTS), F.ceil(n / BLOCK_ELEMENTS), F.lit(1)
    ).cast("int")
    most = F.max(F.struct("m", "n", "label"))
    dealt = (
        counts.groupBy("h").agg(most.alias("x"), F.sum("m").alias("m"), F.sum("n").alias("n"))
        .select(
            "h", F.col("x.label").alias("main"), blocks(F.col("x.m"), F.col("x.n")).alias("inner"),
            blocks(F.col("m") - F.col("x.m"), F.col("n") - F.col("x.n")).alias("outer"),
        )
    )
    placed = members.join(settle(dealt, "dealt"), "h")
    main = F.col("label") == F.col("main")
    placed = placed.withColumn(
        "i", F.pmod(F.xxhash64("node", "h"), F.when(main, F.col("inner")).otherwise(F.col("outer")))
    ).withColumn("i", F.col("i").cast("int"))
    # Block pairs are (x, y): two outer blocks if y < outer, else an outer and an inner one.
    meet = lambda x, y, side: F.struct(
        x.cast("int").alias("x"), y.cast("int").alias("y"), side.cast("int").alias("side")
    )
    i, outer, inner = F.col("i"), F.col("outer"), F.col("inner")
    outside = F.concat(
        F.transform(
            F.sequence(F.lit(0), outer - 1),
            lambda j: meet(
                F.least(i, j), F.greatest(i, j),
                F.when(i == j, F.lit(2)).when(i < j, F.lit(0)).otherwise(F.lit(1)),
            ),
        ),
        F.transform(F.sequence(outer, outer + inner - 1), lambda j: meet(i, j, F.lit(0))),
    )
    inside = F.transform(F.sequence(F.lit(0), outer - 1), lambda j: meet(j, outer + i, F.lit(1)))
    placed = placed.select(
        "h", "node", "label", F.explode(F.when(main, inside).otherwise(outside)).alias("p")
    ).select("h", "node", "label", "p.*")

    def compare(table: pa.Table) -> pa.Table:
        links = _spanning_links(table, similarity)
        return pa.table(
            {
                "a": pa.array([a for a, _ in links], pa.int64()),
                "b": pa.array([b for _, b in links], pa.int64()),
            }
        )

    whole = placed.join(sets.select("node", "own"), "node")
    return whole.groupBy("h", "x", "y").applyInArrow(compare, "a bigint, b bigint")


def _still_open(members: DataFrame, label: DataFrame) -> DataFrame:
    """``members`` with their component's label, in the buckets that hold several components."""
    labelled = members.join(label, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    open_ = labelled.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"))
    return labelled.join(open_.where("x <> y").select("h"), "h")


def near_duplicate_classes(
    docs: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    counted: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, class_id) of every row: classes of texts linked by similar shingle sets.

    Weights are 1 for each distinct shingle, or its occurrences if ``counted``.
    1. Texts with the same words are folded; their smallest id stands for them.
    2. Every text links to the centre (smallest id) that it shares most band buckets with,
       if the exact similarity reaches the limit, and components are formed.
    3. Where a small bucket still holds several components, all pairs of different ones are
       checked.  Larger ones try the text that shares most buckets and centres drawn by
       hash.  New links join the components.
    4. Large buckets that still hold several components compare all pairs of different ones
       in blocks.  So every pair that shares a bucket is checked, or connected already.

    ``class_id`` is the smallest id of the class, whatever null ids it holds.  Texts without words form one class.  Rows
    that share an id are taken as one document, so their texts share a class.  A row with a
    null id shares the class of equal texts; a class of null ids alone has a negative id.
    An empty table gives no rows.  Only the two named columns are used.
    """
    rows = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")
    )
    told = settle(_described(rows, shingle, counted), "signatures")
    first = told.groupBy("digest").agg(
        F.min("doc_id").alias("known"), F.min("node").alias("any")
    )
    first = first.select("digest", "known", F.coalesce("known", "any").alias("first"))
    first = settle(first, "texts")
    distinct = told.join(first, "digest").where("node = first and size(bands) > 0")
    buckets = distinct.select("node", F.explode("bands").alias("h")).distinct()
    buckets = settle(buckets, "buckets")
    shared = buckets.groupBy("h").agg(F.min("node").alias("a"), F.count("*").alias("m"))
    shared = settle(shared.where("m > 1"), "shared")
    members = settle(buckets.join(shared, "h").select("h", "node", "a", "m"), "members")

    stars = (
        members.where("node <> a").groupBy("a", F.col("node").alias("b"))
        .agg(F.count("*").alias("n"))
    )
    stars = settle(stars, "stars")
    best = stars.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("k"))).alias("best"))
    best = best.select((-F.col("best.k")).alias("a"), "b")
    needed = members.select("node").distinct()
    sets = settle(
        _elements(rows, shingle, counted).join(needed, "node").dropDuplicates(["node", "digest"]),
        "sets",
    )
    links = settle(_verified(best, sets, similarity), "links")
    same_id = told.join(first, "digest").where("node <> first").select(
        F.col("node").alias("a"), F.col("first").alias("b")
    )
    shared_ids = same_id.join(first.select(F.col("first").alias("a")), "a", "left_semi")
    links = links.unionByName(shared_ids)
    label = settle(components(links), "labels")

    # Buckets that still hold texts of different components.
    left = settle(_still_open(members, label), "open")
    small = left.where(F.col("m") <= SMALL_BUCKET).select("h", "node", "label")
    pairs = (
        small.select("h", F.col("node").alias("a"), F.col("label").alias("la"))
        .join(small.select("h", F.col("node").alias("b"), F.col("label").alias("lb")), "h")
        .where("la < lb").select("a", "b")
    )
    # A text that many others resemble lies in many full buckets.
    mass = members.groupBy("node").agg(F.sum("m").alias("mass"))
    big = left.where(F.col("m") > SMALL_BUCKET)
    big = settle(big.join(mass, "node").select("h", "node", "label", "mass"), "big")
    for r in range(-1, CENTRES + 1):
        order = -F.col("mass") if r < 0 else F.xxhash64("node", "h", F.lit(r)) if r else F.col("node")
        drawn = F.struct(
            order.alias("x"), F.col("node").alias("a"), F.col("label").alias("la")
        )
        centre = big.groupBy("h").agg(F.min(drawn).alias("c")).select("h", "c.a", "c.la")
        pairs = pairs.unionByName(
            big.select("h", F.col("node").alias("b"), F.col("label").alias("lb"))
            .join(centre, "h").where("la <> lb").select("a", "b")
        )
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # Pairs that were checked before are not checked again.
    pairs = pairs.join(best, ["a", "b"], "left_anti")
    links = settle(links.unionByName(_verified(pairs, sets, similarity)), "links")
    label = settle(components(links), "labels")

    left = _still_open(members.where(F.col("m") > SMALL_BUCKET), label)
    left = settle(left.select("h", "node", "label"), "open")
    if not left.isEmpty():
        more = _block_links(left, sets, similarity)
        label = components(links.unionByName(more))

    classes = first.join(
        label.select(F.col("node").alias("first"), "label"), "first", "left"
    ).select("digest", "known", F.coalesce("label", "first").alias("label"))
    # The number made for a text without an id never stands for a class that has ids.
    made = first.where("known is null").select(F.col("first").alias("label"))
    named = classes.join(made, "label", "left_semi").groupBy("label")
    named = named.agg(F.min("known").alias("named")).where("named is not null")
    classes = classes.join(named, "label", "left").select(
        "digest", F.coalesce("named", "label").alias("class_id")
    )
    return told.select("doc_id", "digest").join(classes, "digest").select("doc_id", "class_id")


def _least_rows(docs: DataFrame, key: str) -> DataFrame:
    """The least row of each key, by the columns in the order of their names."""
    names = sorted(c for c in docs.columns if c != key)
    return docs.groupBy(key).agg(F.min(F.struct(*names)).alias("_row")).select(key, "_row.*")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each near-duplicate class, columns unchanged.

    In a class with ids it is the row of the smallest id; rows that share an id count as one
    document, of which the least row stays (by the columns in the order of their names).  A
    class of null ids alone keeps the least row among those of one of its texts.
    """
    found = near_duplicate_classes(docs, similarity)
    found = settle(found.groupBy("doc_id", "class_id").agg(F.count("*").alias("_copies")), "classes")
    heads = found.where("doc_id = class_id").select("doc_id", "_copies")
    once = docs.join(heads.where("_copies = 1"), "doc_id", "left_semi")
    repeated = docs.join(heads.where("_copies > 1"), "doc_id", "left_semi")
    repeated = _least_rows(repeated, "doc_id").select(*docs.columns)
    made = F.arrow_udf(_made_nodes, "bigint")
    nameless = found.where("doc_id is null").select(F.col("class_id").alias("_node")).distinct()
    loose = docs.where("doc_id is null").withColumn("_node", made("text"))
    loose = _least_rows(loose.join(nameless, "_node", "left_semi"), "_node")
    return once.unionByName(repeated).unionByName(loose.select(*docs.columns))


def _made_nodes(texts: pa.Array) -> pa.Array:
    """The numbers that stand for texts without an id."""
    return pa.array([_named(None, t.as_py())[0] for t in texts], pa.int64())
