"""Suffix automaton search against brute force."""

import hashlib
import random
import re

import pytest

from gridsieve.llm import decontamination as dc
from gridsieve.llm.automaton import SuffixAutomaton, benchmark_words

from llm_texts import documents, made_text  # noqa: F401

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(words, items, size):
    hit, names = set(), set()
    for name, own in items:
        m = min(size, len(own))
        for k in range(len(own) - m + 1 if m else 0):
            for a in range(len(words) - m + 1):
                if words[a : a + m] == own[k : k + m]:
                    hit |= set(range(a, a + m))
                    names.add(name)
    return hit, names


def test_words():
    text = "Don't stop, Élan 42×x_y\x7fz�"
    assert [w.decode() for w in benchmark_words(text)] == words_of(text)
    assert benchmark_words(None) == []


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_brute_force(seed):
    rng = random.Random(seed)
    few = "a b c d"[: rng.choice([3, 5, 7])].split()
    items = [(str(i), made_text(rng, rng.randrange(0, 14), few).split()) for i in range(6)]
    size = rng.choice([2, 4, 5])
    automaton = SuffixAutomaton([(n, [w.encode() for w in ws]) for n, ws in items], size)
    for _ in range(6):
        words = made_text(rng, rng.randrange(0, 40), few + ["x"]).split()
        spans, names = automaton.hits([w.encode() for w in words])
        assert ({k for a, b in spans for k in range(a, b)}, names) == brute(words, items, size)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def _tables(spark, documents, rng):
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, made_text(rng, rng.randrange(5, 40), vocabulary)) for i in range(12)]
    items += [(90, None), (91, ""), (92, items[0][1]), (93, "only four words here")]
    texts = [made_text(rng, rng.randrange(0, 300), vocabulary) for _ in range(40)]
    texts += [a + " " + items[k][1].upper() + ". " + b for k, (a, b) in enumerate(zip(texts, texts[9:20]))]
    texts += [None, "", "ONLY, four words -- here", "x " * 5000 + items[3][1], items[2][1]]
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, items[1][1])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    return rows, items, bench, documents(rows)


@pytest.mark.parametrize("most_words", [400_000, 60])
def test_report(spark, documents, most_words, monkeypatch):
    monkeypatch.setattr(dc.find_contamination, "__defaults__", (13, "text", most_words))
    rows, items, bench, docs = _tables(spark, documents, random.Random(5))
    parsed = [(str(i), words_of(t)) for i, t in items]
    want = []
    for d, t in rows:
        words = words_of(t)
        hit, names = brute(words, parsed, 13)
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        bad = bool(hit) and 20 * len(hit) >= len(words)
        want.append((d, len(words), len(hit), len(names), digest, bad))
    got = dc.contamination_report(docs, bench).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_cleaned_texts(spark, documents):
    rows, items, bench, docs = _tables(spark, documents, random.Random(6))
    parsed = [(str(i), words_of(t)) for i, t in items]
    got = {(r.doc_id, r.text) for r in dc.decontaminate(docs, bench).collect()}
    assert len(got) > 40
    for d, t in got:
        hit, _ = brute(words_of(t), parsed, 13)
        assert not hit or 20 * len(hit) < len(words_of(t))
    kept = {r.doc_id for r in dc.decontaminate(docs, bench, whole_documents=True).collect()}
    bad = {r.doc_id for r in dc.contamination_report(docs, bench).collect() if r.contaminated}
    assert kept == {d for d, _ in rows} - bad
    cut = dc.decontaminate(docs, bench, coverage=0, most_span=10**6)
    assert cut.columns == docs.columns


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    row = dc.contamination_report(documents([(1, "a b")]), bench).first()
    assert (row.n_hit, row.n_items, row.contaminated) == (0, 0, False)
    clash = documents([(1, "a b")]).selectExpr("*", "1 AS spans", "2 AS items")
    assert dc.find_contamination(clash, bench).first()["spans"] == []
    assert dc.contamination_report(documents([]), bench).count() == 0


@pytest.mark.parametrize("most_words", [400_000, 20])
def test_items_without_an_id_are_hit_and_not_named(spark, documents, most_words):
    words = [f"word{i} " for i in range(60)]
    items = [(None, "".join(words[:15])), (None, "tiny item"), (7, "".join(words[20:35]))]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    docs = documents([(1, "".join(words[:14])), (2, "".join(words[:35])), (3, "tiny item"), (4, "clean")])
    found = dc.find_contamination(docs.select("doc_id", "text"), benchmark, most_words=most_words)
    got = {r.doc_id: (r.hit, r["items"]) for r in found.select("doc_id", dc.n_hit().alias("hit"), "items").collect()}
    assert got == {1: (14, []), 2: (30, ["7"]), 3: (2, []), 4: (0, [])}
    report = {r.doc_id: (r.contaminated, r.n_items) for r in dc.contamination_report(docs, benchmark).collect()}
    assert report == {1: (True, 0), 2: (True, 1), 3: (True, 0), 4: (False, 0)}
