"""The trie against brute force, over forced shards and column blocks."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from gridsieve.llm import prefix_trie as pt

NAMES = (
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
)
TYPES = "conv_id bigint, turn bigint, role string, text string"


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v, key=lambda t: t[:3])] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        seq = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
        ends[seq].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    out, leaves, saved = [], {}, {}
    for path in sorted(members, key=len, reverse=True):
        kids = children[path]
        leaves[path] = sum(leaves[k] for k in kids) or 1
        mine = (len(members[path]) - 1) * len(path[-1][1]) if path else 0
        saved[path] = mine + sum(saved[k] for k in kids)
        sha = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        up = members[path[:-1]][0] if path else None
        out.append(
            (members[path][0], len(path), up, len(members[path]), len(kids), leaves[path],
             saved[path], sha)
        )
    return sorted(out, key=repr)


def made_rows(rng, n, deep=8):
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randrange(1, deep)):
            first = "hello" if t == 0 and rng.random() < 0.5 else rng.choice("abc") * (t + 1)
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), first))
    return rows


def trie(df, **kw):
    found = pt.prefix_trie(pt.rebuilt_sequences(pt.turn_sequences(df)), **kw)
    return sorted((tuple(r[n] for n in NAMES) for r in found.collect()), key=repr)


@pytest.mark.parametrize("shard_turns", [40, 100_000])
def test_nodes_equal_brute_force(spark, shard_turns):
    rng = random.Random(5)
    rows = made_rows(rng, 300)
    # A group of equal conversations, one of them the first of its group; odd ids.
    rows += [(c, t, "user", "copy") for c in (1200, 1201, 1202, *range(9000, 9090)) for t in range(4)]
    rows += [(10**15 + 7, 0, None, None), (10**15 + 8, None, "user", "é😀"), (None, 1, "user", "x")]
    # Repeated rows and null turn numbers.
    rows += [(5555, 1, "user", "again"), (5555, 1, "user", "again"), (5555, None, "system", "")]
    df = spark.createDataFrame(rows, TYPES).repartition(7)
    df = df.selectExpr("*", "'x' AS n", "1 AS depth", "2 AS seq", "3 AS hi")
    assert trie(df, shard_turns=shard_turns) == brute(rows)


def test_long_conversations(spark):
    rng = random.Random(6)
    rows = [(c, t, "user", "same" if t < 70 + c % 7 else rng.choice("ab")) for c in range(1, 25)
            for t in range(rng.choice([3, 71, 100, 200]))]
    rows += [(77, t, "user", f"{t} " * 500) for t in range(3000)]
    df = spark.createDataFrame(rows, TYPES).repartition(3)
    assert trie(df, shard_turns=500) == brute(rows)


def test_levels_do_not_depend_on_the_columns():
    rng = np.random.default_rng(1)
    seqs = sorted({tuple(rng.integers(1, 3, rng.integers(0, 12))) for _ in range(300)})
    rng.shuffle(seqs)
    offsets = np.cumsum([0, *map(len, seqs)])
    ids = np.array([x for s in seqs for x in s], dtype=np.int32)
    weight, conv = rng.integers(1, 9, len(seqs)), rng.permutation(len(seqs))
    for columns in (1, 3, 32):
        levels, order = pt.trie_levels(ids, offsets, weight, conv, columns)
        assert [seqs[k] for k in order] == sorted(seqs)
        for depth, level in enumerate(levels):
            sums, least = defaultdict(int), {}
            for s, w, c in zip(seqs, weight, conv):
                if len(s) >= depth:
                    sums[s[:depth]] += w
                    least[s[:depth]] = min(c, least.get(s[:depth], c))
            paths = [seqs[r][:depth] for r in level.row]
            assert paths == sorted(sums)
            assert [sums[p] for p in paths] == level.n.tolist()
            assert [least[p] for p in paths] == level.conv.tolist()


def test_hot_conversation_is_digested_in_stretches(spark):
    rows = [(c, 0, "user", "hot") for c in range(1, 20_000)]
    df = spark.createDataFrame(rows, TYPES).repartition(5)
    parts = pt.turn_sequences(df)
    got = pt.distinct_sequences(parts).collect()
    want = hashlib.sha256(",".join(str(c) for c in range(1, 20_000)).encode()).hexdigest()
    assert [(r.n, r.conv_id, r.ends_sha256) for r in got] == [(19_999, 1, want)]


def test_empty_table(spark):
    assert trie(spark.createDataFrame([], TYPES)) == []


def test_last_turns(spark):
    rows = [(100, 0, "user", "a"), (100, 1, "user", "b"), (101, 0, "user", "c"), (7, 0, None, "d")]
    df = spark.createDataFrame(rows, TYPES)
    out = pt.node_turns(pt.conversation_trie(df), df).collect()
    found = {(r.depth, r.role, r.text) for r in out}
    assert (0, None, None) in found and (1, "user", "a") in found and len(out) == len(brute(rows))
