"""FM-index search and repeated windows against brute force."""

import hashlib
import random

import numpy as np
import pytest
from llm_texts import documents, made_text  # noqa: F401

from gridsieve.llm import substring_index as si
from gridsieve.llm.fm_index import FMIndex, earliest, matching_windows
from gridsieve.llm.shingles import words_of


@pytest.mark.parametrize("seed", range(12))
def test_backward_search(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(1, [3, 9, 70][seed % 3], 250)
    text[rng.integers(0, 250, 8)] = 0
    text[-1] = 0
    index, size = FMIndex(text), [1, 3, 5][seed % 3]
    ends = np.arange(size, 251)
    alive, low, high = matching_windows(index, text, ends, size)
    first = dict(zip(alive.tolist(), zip(earliest(index, low, high).tolist(), (high - low).tolist())))
    for i, e in enumerate(ends.tolist()):
        own = text[e - size : e].tolist()
        places = [a for a in range(251 - size) if text[a : a + size].tolist() == own]
        assert first.get(i) == ((places[0], len(places)) if len(places) > 1 else None)


def brute(rows):
    """(doc_id, words, removed, digest) of every row."""
    place = lambda i: (rows[i][0] is not None, rows[i][0] or 0, si.row_key(*rows[i]))
    seen, out = {}, []
    for i, (_, t) in enumerate(rows):
        ws = words_of(t)
        for a in range(len(ws) - 19):
            w = tuple(ws[a : a + 20])
            seen[w] = min(seen.get(w, (place(i), a)), (place(i), a))
    for i, (d, t) in enumerate(rows):
        ws, gone = words_of(t), set()
        for a in range(len(ws) - 19):
            if seen[tuple(ws[a : a + 20])] < (place(i), a):
                gone |= set(range(a, a + 20))
        kept = b" ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((d, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def _rows():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [made_text(rng, n, vocabulary) for n in (12, 19, 20, 21, 25, 60, 200)]
    rows = []
    for i in range(90):
        parts = [made_text(rng, rng.randrange(0, 60), vocabulary)]
        for _ in range(rng.randrange(0, 3)):
            parts += [rng.choice(passage), made_text(rng, rng.randrange(0, 30), vocabulary)]
        rows.append((i * 7 % 101, "\n".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(10)]
    rows += [(300, "la " * 400), (301, "la la " * 100 + "x"), (302, None), (303, ""), (304, "a b")]
    rows += [(305, made_text(rng, 300, ["p", "q"])), (306, made_text(rng, 300, ["p", "q"]))]
    return rows + [rows[4], (rows[5][0], rows[6][1]), (None, rows[8][1]), (None, passage[5])]


@pytest.mark.parametrize("forms,broadcast", [(1000, 1 << 20), (2, 0), (0, 1 << 20)])
def test_repeats_equal_brute_force(spark, documents, monkeypatch, forms, broadcast):
    monkeypatch.setattr(si, "MOST_FORMS", forms)
    monkeypatch.setattr(si, "BROADCAST_BYTES", broadcast)
    rows = _rows()
    got = sorted((tuple(r) for r in si.repeats_report(documents(rows)).collect()), key=str)
    assert got == brute(rows)


def test_cleaned_texts(spark, documents):
    docs = documents(_rows()[:60])
    got = si.remove_repeats(docs)
    assert got.columns == docs.columns
    texts = {r.doc_id: r.text for r in got.collect()}
    digests = {r.doc_id: (r.n_words - r.n_removed, r.kept_sha256) for r in si.repeats_report(docs).collect()}
    for d, (left, digest) in digests.items():
        assert (d in texts) == (left > 0 or d not in texts and left > 0) or left == 0
        if d in texts:
            assert hashlib.sha256(b" ".join(words_of(texts[d]))).hexdigest() == digest
    assert si.repeats_report(documents([])).count() == 0


def test_every_later_copy_of_a_form_is_found_under_null_and_repeated_ids(spark):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(None, words), (3, words), (3, words + " end"), (7, words), (9, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = si.repeats_report(docs).collect()
    # A null id is the earliest; every word that the others share with it goes.
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in found) == [
        ("3", 30), ("3", 30), ("7", 30), ("9", 0), ("None", 0),
    ]


def test_texts_meet_their_spans_without_a_pass_through_python(spark, documents):
    found = si.find_repeats(documents(_rows()[:20]))
    assert "MapInArrow" not in found._jdf.queryExecution().toString()


def test_segments_are_cut_once(spark, documents, monkeypatch):
    plans, kept = [], si.settle

    def settle(df, label="table", keep=False):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow"))
        return kept(df, label, keep)

    monkeypatch.setattr(si, "settle", settle)
    assert si._repeated_segments(
        documents(_rows()).selectExpr("doc_id AS doc", "text")
    ).count() > 0
    # Only the table of all segments comes from Python; both readers of it do without.
    assert plans == [1, 0, 0]


def test_repeats_are_cut_in_one_pass_through_python(spark):
    """Texts and the filter come from one pass; other columns, nulls and texts without words stay."""
    words = " ".join(f"w{k}" for k in range(30))
    rows = [(1, words, b"a"), (2, words, b"b"), (3, f"x\t{words}\ny", None), (4, None, b"d"), (5, " ", b"e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, more binary")
    got = si.remove_repeats(docs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and plan.count("MapInArrow") == 1
    want = [(1, words, b"a"), (3, "x\ty", None), (4, None, b"d"), (5, " ", b"e")]
    assert [(r[0], r[1], r[2] and bytes(r[2])) for r in got.orderBy("doc_id").collect()] == want
    assert got.columns == docs.columns
