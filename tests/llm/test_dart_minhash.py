"""Signatures against exact similarities, classes against brute force."""

import random

import numpy as np
import pytest
from llm_texts import documents, made_text  # noqa: F401

from gridsieve.llm import dart_minhash as dm
from gridsieve.llm.components import components
from gridsieve.llm.shingles import shingles, words_of


@pytest.mark.parametrize("weights", ["one", "counts", "fractions"])
def test_agreement_estimates_weighted_jaccard(weights):
    rng = np.random.default_rng(3)
    sets, wants = [], []
    for n in (3, 40, 900):
        for share in (0.2, 0.8):
            universe = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
            draw = {"one": lambda: np.ones(2 * n), "counts": lambda: rng.integers(1, 6, 2 * n) * 1.0,
                    "fractions": lambda: rng.random(2 * n) * 3 + 0.01}[weights]
            a = draw()
            b = np.where(rng.random(2 * n) < share, a, draw() * (rng.random(2 * n) < 0.5))
            for w in (a, b):
                sets.append((universe[w > 0], w[w > 0]))
            wants.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    got = dm.signatures(sets, k=2048)
    for i, want in enumerate(wants):
        same = (got[2 * i] == got[2 * i + 1]).mean()
        assert abs(same - want) < 0.06, (i, same, want)


def test_signature_does_not_depend_on_company():
    sets = [(np.unique(shingles(made_text(random.Random(i), 5 + 7 * i))), None) for i in range(30)]
    sets = [(h, np.ones(len(h))) for h, _ in sets]
    together = dm.signatures(sets)
    for i, s in enumerate(sets):
        assert (dm.signatures([s])[0] == together[i]).all()
    assert (dm.signatures([(np.empty(0, np.uint64), np.empty(0))]) == 0).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)]
    edges += [(1000, 1000 + i) for i in range(1, 50)] + [(2000 + i, 2001 + i) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.label for r in got} == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert len(got) == len({r.node for r in got})
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def changed(rng, text, share):
    return " ".join(w if rng.random() > share else f"x{rng.randrange(10**6)}" for w in text.split())


def brute(rows, counted=False):
    """Smallest id of the class of every row, from all pairs."""
    sets = []
    for d, t in rows:
        ws = words_of(t)
        m = min(5, len(ws))
        own = [tuple(ws[i : i + m]) for i in range(len(ws) - m + 1)] if ws else []
        sets.append({(s, own[:i].count(s)) for i, s in enumerate(own)} if counted else set(own))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = words_of(rows[i][1]) == words_of(rows[j][1])
            same |= rows[i][0] is not None and rows[i][0] == rows[j][0]
            both, union = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if same or (union and 5 * both >= 4 * union):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    members = {}
    for i, (d, _) in enumerate(rows):
        members.setdefault(find(i), []).append(i)
    return sorted(sorted(str(rows[i][0]) for i in m) for m in members.values())


def _rows():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for n in (6, 30, 80, 200, 600):
        for _ in range(4):
            base = made_text(rng, n, vocabulary)
            texts += [base, base.replace(" ", "\n", 2)]
            texts += [changed(rng, base, rng.choice([0.005, 0.01, 0.02, 0.04])) for _ in range(5)]
            long = base
            for _ in range(4):  # a chain whose ends differ
                long = long + " " + made_text(rng, max(1, n // 12), vocabulary)
                texts.append(long)
    hot = made_text(rng, 300, vocabulary)
    texts += [changed(rng, hot, 0.01) for _ in range(60)] + [hot] * 20
    texts += ["", None, " \n", "one", "one", "two words", "a b c d", "la " * 3000, "la " * 2000]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    return rows + [(7, texts[7]), (None, texts[9]), (None, "alone without an id here now"), (9, "a second text of nine")]


@pytest.mark.parametrize("counted", [False, True])
def test_classes_equal_brute_force(spark, documents, counted):
    rows = _rows()
    found = dm.near_duplicate_classes(documents(rows), counted=counted).collect()
    assert len(found) == len(rows)
    groups = {}
    for r in found:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    for label, members in groups.items():
        known = [m for m in members if m is not None]
        assert label == min(known) if known else label < 0
    assert sorted(sorted(map(str, m)) for m in groups.values()) == brute(rows, counted)


def test_keep_one(spark, documents):
    rows = _rows()
    docs = documents(rows)
    kept = dm.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    classes = {r.class_id for r in dm.near_duplicate_classes(docs).collect()}
    assert sorted(i for i in ids if i is not None) == sorted(c for c in classes if c >= 0)
    assert dm.near_duplicate_classes(documents([])).count() == 0
    assert dm.keep_one(documents([])).count() == 0


def test_null_ids_never_stand_for_a_class_with_ids(spark, documents):
    rng = random.Random(4)
    t, other = made_text(rng, 200), made_text(rng, 200, [f"v{i}" for i in range(500)])
    rows = [(1, t), (3, t + " y"), (None, t + " x"), (None, t)]
    rows += [(None, other), (None, other + " x"), (None, other), (None, "a lone text of its own")]
    rows += [(7, "id shared by"), (7, "two different texts"), (7, "two different texts")]
    found = dm.near_duplicate_classes(documents(rows)).collect()
    assert sorted(r.class_id for r in found if r.class_id > 0) == [1] * 4 + [7] * 3
    kept = sorted(((r.doc_id, r.text) for r in dm.keep_one(documents(rows)).collect()), key=repr)
    named = [r for r in kept if r[0] is not None]
    assert named == [(1, t), (7, "id shared by")]
    loose = [r[1] for r in kept if r[0] is None]
    assert len(loose) == 2 and "a lone text of its own" in loose
    # Rows that share an id and a text, and rows without ids, stay once.
    rows = [(None, t), (None, t + " x"), (None, None), (None, ""), (2, " ")]
    kept = dm.keep_one(documents(rows)).collect()
    assert len(kept) == 2 and [r.doc_id for r in kept if r.doc_id is not None] == [2]


def test_copies_of_a_middle_original_are_one_class(spark, documents):
    """Copies resemble the original only, which is not the smallest id of their buckets."""
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = made_text(rng, 404, vocabulary).split()
    rows = []
    for i in range(300):
        text = list(base)
        if i != 150:
            for at in rng.sample(range(4, 400, 5), 7):
                text[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    # A second group shares the buckets but not the class.
    far = list(base)
    for at in range(2, 402, 23):
        far[at] = f"y{at}"
    rows += [(1000 + i, " ".join([*far[:-1], f"z{i}"])) for i in range(80)]
    found = dm.near_duplicate_classes(documents(rows)).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.class_id, []).append(r.doc_id)
    assert sorted(sorted(map(str, m)) for m in groups.values()) == brute(rows)
    assert {r.class_id for r in found if r.doc_id < 300} == {0}


def test_block_links_join_all_similar_components(spark, monkeypatch):
    """Without any centre, and with blocks much smaller than the bucket."""
    monkeypatch.setattr(dm, "BLOCK_TEXTS", 7)
    monkeypatch.setattr(dm, "COLUMNS", 16)
    rng = np.random.default_rng(6)
    base = rng.choice(2**31 - 1, 120, replace=False)
    sets = []
    for i in range(90):
        own = set(base[: 60 + 60 * (i % 2)].tolist())
        for x in rng.choice(sorted(own), rng.integers(0, 9), replace=False).tolist():
            own.remove(x)
        sets.append(sorted(own | set(rng.choice(2**31 - 1, rng.integers(0, 6)).tolist())))
    label = [0 if i < 30 else i for i in range(90)]
    members = spark.createDataFrame([(5, i, label[i]) for i in range(90)], "h bigint, node bigint, label bigint")
    table = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "node bigint, own array<int>")
    links = [(r.a, r.b) for r in dm._block_links(members, table, 0.8).collect()]

    def classes(edges):
        root = list(label)
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    similar = [
        (i, j) for i in range(90) for j in range(i)
        if 5 * len(set(sets[i]) & set(sets[j])) >= 4 * len(set(sets[i]) | set(sets[j]))
    ]
    assert classes(links) == classes(similar)
    assert set(map(frozenset, links)) <= set(map(frozenset, similar))
