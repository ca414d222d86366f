"""Conversation prefix trie from padded turn-id matrices, sorted shard by shard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.shingles import mix
from gridsieve.session import attach_small, settle

# Conversations c and c - c % GROUP share their first crc32(c) % MOST_SHARED turns.
GROUP = 100
MOST_SHARED = 6
# Turns of distinct sequences in one shard (about), and columns of a matrix at a time.
SHARD_TURNS = 200_000
COLUMNS = 32
# Ids of members are joined in stretches of this many numbers before they are digested.
STRETCH = 4096

SEQUENCE = "array<struct<hi:bigint,lo:bigint,chars:bigint>>"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)

_NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
    "n_leaves bigint, saved_tokens bigint, ends_sha256 string"
)
_PARTIAL = f"{_NODE}, shared boolean, d1 bigint, d2 bigint, p1 bigint, p2 bigint, chars bigint"


def _nodes_schema(partial: bool) -> pa.Schema:
    long = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves"]
    fields = [(c, pa.int64()) for c in [*long, "saved_tokens"]] + [("ends_sha256", pa.string())]
    if partial:
        fields += [("shared", pa.bool_())]
        fields += [(c, pa.int64()) for c in ("d1", "d2", "p1", "p2", "chars")]
    return pa.schema(fields)


def turn_sequences(turns: DataFrame) -> DataFrame:
    """conv_id and its turns in order, each as a 128-bit key of (role, text) and its code points.

    Turn numbers order the turns, null first; equal numbers stand in the order of role and
    key.  Null role or text is empty.  Rows without conv_id belong to no conversation.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct(
        F.col("turn").isNotNull().alias("later"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        role.alias("role"),
        F.xxhash64(role, text).alias("hi"),
        F.xxhash64(F.lit("turn"), text, role).alias("lo"),
        F.length(text).cast("bigint").alias("chars"),
    )
    keyed = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t")
    )
    ordered = F.array_sort(F.collect_list("t"))
    bare = F.transform(ordered, lambda t: F.struct(t["hi"], t["lo"], t["chars"]))
    return keyed.groupBy("conv_id").agg(bare.cast(SEQUENCE).alias("seq"))


def _shared_turns(conv_id: Column) -> Column:
    return (F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED).cast("int")


def rebuilt_sequences(sequences: DataFrame) -> DataFrame:
    """Every conversation with the first turns of its group's first conversation in front.

    At most ``MOST_SHARED - 1`` turns of the first conversation travel, to fewer than
    ``GROUP`` others.
    """
    conv = F.col("conv_id")
    first = sequences.where(F.pmod(conv, F.lit(GROUP)) == 0).select(
        conv.alias("first_id"), F.slice("seq", 1, MOST_SHARED - 1).alias("first_seq")
    )
    own = sequences.withColumn("first_id", conv - F.pmod(conv, F.lit(GROUP)))
    shared = _shared_turns(conv)
    head = F.slice(F.coalesce("first_seq", F.array().cast(SEQUENCE)), F.lit(1), shared)
    rest = F.slice("seq", shared + 1, F.greatest(F.size("seq"), F.lit(1)))
    return own.join(first, "first_id", "left").select(
        "conv_id", F.concat(head, rest).cast(SEQUENCE).alias("seq")
    )


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """seq, n, conv_id (smallest), ends_sha256 of each distinct sequence.

    Ids are joined in stretches first; the digest is then streamed over the stretches of a
    sequence in order, so that no list of members is ever held as a whole.
    """
    part = sequences.groupBy("seq", F.floor(F.col("conv_id") / STRETCH).alias("stretch")).agg(
        F.array_sort(F.collect_list("conv_id")).alias("ids")
    )
    part = part.select(
        "seq",
        "stretch",
        F.xxhash64("seq").alias("e1"),
        F.xxhash64(F.lit("sequence"), "seq").alias("e2"),
        F.size("ids").cast("bigint").alias("n"),
        F.element_at("ids", 1).alias("conv_id"),
        F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"),
    )
    part = part.repartition("e1", "e2").sortWithinPartitions("e1", "e2", "stretch")
    schema = f"seq {SEQUENCE}, n bigint, conv_id bigint, ends_sha256 string"
    return part.select("seq", "e1", "e2", "n", "conv_id", "text").mapInArrow(_digests, schema)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal (e1, e2); a run may span batches."""
    open_key = open_seq = open_sha = None
    open_n = open_conv = 0

    def record(sequences, rows):
        n, conv, sha = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [sequences, pa.array(n, pa.int64()), pa.array(conv, pa.int64()), pa.array(sha)],
            names=["seq", "n", "conv_id", "ends_sha256"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        e1, e2, n, conv = (batch.column(k).to_numpy() for k in range(1, 5))
        texts = batch.column(5).to_pylist()
        change = np.ones(len(e1), dtype=bool)
        change[1:] = (e1[1:] != e1[:-1]) | (e2[1:] != e2[:-1])
        if (int(e1[0]), int(e2[0])) == open_key:
            change[0] = False
        starts = np.flatnonzero(change).tolist()
        sequences, rows, at = [], [], 0
        for k, end in enumerate([*starts, len(texts)]):
            for i in range(at, end):
                if open_n:
                    open_sha.update(b",")
                open_sha.update(texts[i].encode())
                open_conv = min(open_conv, int(conv[i])) if open_n else int(conv[i])
                open_n += int(n[i])
            if k < len(starts):
                if open_key is not None:
                    sequences.append(open_seq)
                    rows.append((open_n, open_conv, open_sha.hexdigest()))
                open_key, open_seq = (int(e1[end]), int(e2[end])), batch.column(0).slice(end, 1)
                open_n, open_sha = 0, hashlib.sha256()
            at = end
        # The open sequence must not keep its whole batch in memory.
        open_seq = pa.concat_arrays([open_seq])
        if rows:
            yield record(pa.concat_arrays(sequences), rows)
    if open_key is not None:
        yield record(open_seq, [(open_n, open_conv, open_sha.hexdigest())])


@dataclass
class Level:
    """Nodes of one depth in one shard, in sorted order."""

    start: np.ndarray  # sorted position of the first sequence below the node
    row: np.ndarray  # that sequence
    parent: np.ndarray  # index in the level above
    n: np.ndarray
    conv: np.ndarray
    ends: np.ndarray  # whether that sequence ends here


def _turn_ids(hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Numbers from 1 for distinct keys, in the order of (hi, lo)."""
    if not len(hi):
        return np.empty(0, np.int32)
    order = np.lexsort((lo, hi))
    new = np.ones(len(hi), dtype=bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    ids = np.empty(len(hi), np.int32)
    ids[order] = np.cumsum(new)
    return ids


def trie_levels(
    ids: np.ndarray, offsets: np.ndarray, weight: np.ndarray, conv: np.ndarray,
    columns: int = COLUMNS,
) -> tuple[list[Level], np.ndarray]:
    """Levels of the trie of distinct sequences, and the sequences' sorted order.

    Padded matrices of ``columns`` turn ids are sorted with lexsort, block after block for the
    sequences that reach so far.  A column's changes are OR-ed onto the mask of the columns
    before it; what the mask marks starts a node, and reduceat sums over the marks.
    """
    lengths = np.diff(offsets)
    order = np.argsort(lengths > 0, kind="stable")  # the empty sequence comes first
    root, total = np.zeros(1, dtype=np.int64), np.array([weight.sum()])
    levels = [Level(root, order[:1], root, total, np.array([conv.min()]), lengths[order[:1]] == 0)]
    place = np.flatnonzero(lengths[order] > 0)
    group, base = np.zeros(len(place), dtype=np.int64), 0
    while len(place):
        rows = order[place]
        deep = np.minimum(lengths[rows] - base, columns)
        width = int(deep.max())
        matrix = np.zeros((len(rows), width), dtype=np.int32)
        filled = np.arange(width) < deep[:, None]
        flat = np.repeat(offsets[rows] + base - np.cumsum(deep) + deep, deep)
        matrix[filled] = ids[flat + np.arange(len(flat))]
        perm = np.lexsort((lengths[rows] > base + width, *matrix.T[::-1], group))
        rows, matrix = rows[perm], matrix[perm]
        order[place] = rows
        mask = np.ones(len(rows), dtype=bool)
        mask[1:] = group[1:] != group[:-1]
        w, c = weight[rows], conv[rows]
        for j in range(width):
            mask[1:] |= matrix[1:, j] != matrix[:-1, j]
            marks = np.flatnonzero(mask)
            real = matrix[marks, j] > 0
            first = marks[real]
            start, above = place[first], levels[-1].start
            levels.append(
                Level(
                    start, rows[first], np.searchsorted(above, start, side="right") - 1,
                    np.add.reduceat(w, marks)[real], np.minimum.reduceat(c, marks)[real],
                    lengths[rows[first]] == base + j + 1,
                )
            )
        base += columns
        group = np.cumsum(mask)
        reach = lengths[rows] > base
        place, group = place[reach], group[reach]
    return levels, order


def _path_digests(hi: np.ndarray, lo: np.ndarray) -> list[tuple[int, int]]:
    """A 128-bit key for each prefix of one sequence; (0, 0) is the root."""
    a = b = np.uint64(0)
    out = [(0, 0)]
    with np.errstate(over="ignore"):
        for x, y in zip(hi.view(np.uint64), lo.view(np.uint64)):
            a = mix(a * _GOLDEN + x + np.uint64(1))
            b = mix(b * _GOLDEN + y + np.uint64(2))
            out.append((int(a.astype(np.int64)), int(b.astype(np.int64))))
    return out


def _shard_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of one shard of the sorted sequences.

    A node that holds the first or the last sequence may go on in the next shard.  It is
    marked ``shared`` and has only the sums of the others below it.
    """
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    shard = pa.Table.from_batches(held).combine_chunks()
    seq = shard.column("seq").chunk(0)
    offsets = seq.offsets.to_numpy().astype(np.int64)
    turns = seq.values
    hi, lo, chars = (turns.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    weight, conv = shard.column("n").to_numpy(), shard.column("conv_id").to_numpy()
    sha = shard.column("ends_sha256").to_numpy()
    levels, order = trie_levels(_turn_ids(hi, lo), offsets, weight, conv)
    sides = []
    for row in (order[0], order[-1]):
        at = slice(offsets[row], offsets[row + 1])
        sides.append(_path_digests(hi[at], lo[at]))
    shared = [np.zeros(len(v.start), dtype=bool) for v in levels]
    keys: list[dict[int, tuple[int, int]]] = [{} for _ in levels]
    for path, at in zip(sides, (0, -1)):
        for depth, key in enumerate(path):
            k = at % len(levels[depth].start)
            shared[depth][k] = True
            keys[depth][k] = key

    below = [np.zeros(len(levels[-1].start), np.int64) for _ in range(3)]
    out = []
    for depth in range(len(levels) - 1, -1, -1):
        v, edge = levels[depth], shared[depth]
        children, leaves, saved = below
        length = chars[offsets[v.row] + depth - 1] if depth else np.zeros(1, np.int64)
        whole = ~edge
        leaves = leaves + (whole & (children == 0))
        saved = saved + np.where(whole, (v.n - 1) * length, 0)
        ends = np.where(v.ends, sha[v.row], np.where(edge, None, EMPTY_SHA))
        own = _keys_of(keys[depth], len(v.start))
        up = _keys_of(keys[depth - 1], len(levels[depth - 1].start)) if depth else (None, None)
        parent_conv, above = [None] * len(v.start), (None, None)
        if depth:
            held = shared[depth - 1][v.parent]
            parent_conv = pa.array(levels[depth - 1].conv[v.parent], mask=held)
            above = [pa.array(x[v.parent], mask=~held) for x in up]
        nulls = pa.nulls(len(v.start), pa.int64())
        out.append(
            pa.RecordBatch.from_arrays(
                [
                    pa.array(v.conv), pa.array(np.full(len(v.start), depth)),
                    parent_conv if depth else nulls, pa.array(v.n), pa.array(children),
                    pa.array(leaves), pa.array(saved), pa.array(ends, pa.string()),
                    pa.array(edge), *[pa.array(x, mask=whole) for x in own],
                    *[x if depth else nulls for x in above], pa.array(length),
                ],
                schema=_nodes_schema(True),
            )
        )
        if depth:
            below = [np.zeros(len(levels[depth - 1].start), np.int64) for _ in range(3)]
            mine = v.parent[whole]
            for total, part in zip(below, (np.ones(len(mine), np.int64), leaves[whole], saved[whole])):
                np.add.at(total, mine, part)
    yield from out


def _keys_of(keys: dict[int, tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.zeros((2, n), dtype=np.int64)
    for k, key in keys.items():
        both[:, k] = key
    return both[0], both[1]


def _recombined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shared nodes with the sums of the shared nodes below them added, deepest first."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    known = {(r["depth"], r["d1"], r["d2"]): r for r in rows}
    rows.sort(key=lambda r: -r["depth"])
    for r in rows:
        r["n_leaves"] += r["n_children"] == 0
        r["saved_tokens"] += (r["n_convs"] - 1) * r["chars"]
        r["ends_sha256"] = r["ends_sha256"] or EMPTY_SHA
        if r["depth"]:
            up = known[r["depth"] - 1, r["p1"], r["p2"]]
            r["parent_conv_id"] = up["conv_id"]
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    names = [f.name for f in _nodes_schema(True)]
    for at in range(0, len(rows), 10_000):
        some = [{c: r.get(c) for c in names} for r in rows[at : at + 10_000]]
        yield pa.RecordBatch.from_pylist(some, schema=_nodes_schema(True))


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """Nodes of the trie of (conv_id, seq) rows.

    Distinct sequences are range-partitioned, so a common beginning spreads over as many
    shards as it needs; each shard computes its nodes alone.  Only the nodes on a shard's two
    outer paths can go on in another shard: those few, two paths a shard, are added up.
    A member's turns (24 bytes each) and one shard are in a worker's memory.
    """
    spark = sequences.sparkSession
    distinct = settle(distinct_sequences(sequences), "sequences")
    turns = distinct.agg(F.sum(F.size("seq") + 1)).first()[0] or 0
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(at_least, -(-turns // shard_turns))
    sharded = distinct.repartitionByRange(shards, "seq")
    nodes = settle(sharded.mapInArrow(_shard_nodes, _PARTIAL), "trie")
    parts = nodes.where("shared").groupBy("depth", "d1", "d2").agg(
        F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        *[F.max(c).alias(c) for c in ("ends_sha256", "chars", "p1", "p2")],
    )
    shared = settle(parts.coalesce(1).mapInArrow(_recombined, _PARTIAL), "shared")
    names = _nodes_schema(False).names
    up = shared.select(
        (F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"),
        F.col("conv_id").alias("up"),
    )
    whole = nodes.where("NOT shared")
    inner = whole.where("parent_conv_id IS NOT NULL").select(names)
    outer = attach_small(whole.where("parent_conv_id IS NULL"), up, ["depth", "p1", "p2"])
    outer = outer.withColumn("parent_conv_id", F.col("up")).select(names)
    return inner.unionByName(outer).unionByName(shared.select(names))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, over all rebuilt conversations.

    Null roles and texts are empty; rows without conv_id are left out; null turn numbers come
    first, equal ones in the order of role and key; repeated rows are turns of their own; an
    empty table gives no rows.  Other columns are not read.
    """
    return prefix_trie(rebuilt_sequences(turn_sequences(turns)))


def node_turns(nodes: DataFrame, turns: DataFrame) -> DataFrame:
    """``nodes`` with role and text of each node's last turn; the root has nulls.

    The turn is taken from the node's smallest member, which is rebuilt to find it: either
    turn ``depth`` of its group's first conversation or its own.
    """
    turn = F.struct(
        F.col("turn").isNotNull().alias("later"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.xxhash64(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("hi"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    told = turns.where("conv_id IS NOT NULL").groupBy(
        F.col("conv_id").cast("bigint").alias("_conv")
    ).agg(F.array_sort(F.collect_list(turn)).alias("_turns"))
    told = told.select("_conv", F.posexplode("_turns").alias("_at", "_turn")).select(
        "_conv", (F.col("_at") + 1).cast("bigint").alias("depth"), "_turn.role", "_turn.text"
    )
    conv = F.col("conv_id")
    from_first = F.col("depth") <= _shared_turns(conv)
    sourced = nodes.withColumn(
        "_conv", F.when(from_first, conv - F.pmod(conv, F.lit(GROUP))).otherwise(conv)
    )
    return sourced.join(told, ["_conv", "depth"], "left").drop("_conv")


# The rebuilt conversations and their trie in SQL.  DuckDB has no crc32: a list of the
# bytes, each followed by eight shifts, is folded instead.
TRIE_SQL = """WITH RECURSIVE ids AS (SELECT DISTINCT conv_id AS c FROM conversations
  WHERE conv_id IS NOT NULL),
crc AS (SELECT c, CAST(xor(list_reduce(list_concat([4294967295::BIGINT],
    flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda ch: [CAST(ascii(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, b: CASE WHEN b >= 0 THEN xor(a, b)
                   ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END),
  4294967295::BIGINT) AS BIGINT) % 6 AS h FROM ids),
own AS (SELECT conv_id AS c, list({'role': coalesce(role, ''), 'text': coalesce("text", '')}
    ORDER BY turn NULLS FIRST, coalesce(role, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
rebuilt AS (SELECT own.c, list_concat(coalesce(f.turns[1:h], []), own.turns[h + 1:]) AS seq
  FROM own JOIN crc USING (c) LEFT JOIN own f ON f.c = own.c - own.c % 100),
member AS (SELECT c, len(seq) AS size, d, seq[1:d] AS path
  FROM rebuilt, unnest(range(0, len(seq) + 1)) AS u(d)),
node AS (SELECT path, d, min(c) AS conv_id, count(*) AS n,
    CASE WHEN d = 0 THEN 0 ELSE (count(*) - 1) * length(path[d].text) END AS saved,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (size = d), '')) AS sha
  FROM member GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
known AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids
  USING (path)),
below AS (SELECT path[1:k] AS path, sum(saved) AS saved_tokens,
    count(*) FILTER (n_children = 0) AS n_leaves
  FROM known, unnest(range(0, d + 1)) AS u(k) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id,
  CAST(n.n AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
  CAST(b.n_leaves AS BIGINT) AS n_leaves, CAST(b.saved_tokens AS BIGINT) AS saved_tokens,
  n.sha AS ends_sha256
FROM known n JOIN below b USING (path)
LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.path = n.path[1:n.d - 1]"""
