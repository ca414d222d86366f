import random
import re

import pytest
from llm_texts import documents  # noqa: F401

from gridsieve.llm.license_scan import BASE_PHRASES, evaluate, scan_licenses, scan_text

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(text):
    words = WORD.findall(lowered(text))
    places, labels = [], set()
    for phrase, label in BASE_PHRASES.items():
        want = phrase.split()
        for i in range(len(words) - len(want) + 1):
            if words[i : i + len(want)] == want:
                places.append(i)
                labels.add(label)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(labels)),
    )


def value(text):
    terms, sound = evaluate(re.findall(r"[()]|[a-z0-9][a-z0-9.:_-]*\+?", text))
    return (terms.text, terms.level, sorted(terms.choice), sound) if terms else (None, sound)


@pytest.mark.parametrize(
    "text, want",
    [
        ("mit", ("mit", 1, ["mit"], True)),
        ("mit or gpl-2.0 and bsd-3-clause",
         ("mit OR gpl-2.0 AND bsd-3-clause", 1, ["mit"], True)),
        ("(mit or gpl-2.0) and mpl-2.0",
         ("(mit OR gpl-2.0) AND mpl-2.0", 2, ["mit", "mpl-2.0"], True)),
        ("gpl-2.0-or-later with classpath-exception-2.0",
         ("gpl-2.0-or-later WITH classpath-exception-2.0", 2, ["gpl-2.0"], True)),
        ("gpl-3.0+ or gpl-2.0", ("gpl-3.0+ OR gpl-2.0", 3, ["gpl-3.0"], True)),
        ("((mit))", ("mit", 1, ["mit"], True)),
        ("mit and foo", ("mit AND foo", 5, ["mit", "other"], True)),
        ("(mit or gpl-2.0", ("mit OR gpl-2.0", 1, ["mit"], False)),
        ("mit or", ("mit", 1, ["mit"], False)),
        ("mit see the file", ("mit", 1, ["mit"], True)),
        ("mit ) or gpl-2.0", ("mit", 1, ["mit"], True)),
        ("or and", (None, False)),
        ("()", (None, False)),
        ("", (None, False)),
        ("(mit and) or isc", ("mit OR isc", 1, ["mit"], False)),
    ],
)
def test_expressions(text, want):
    assert value(text) == want


def test_deep_brackets_take_linear_time():
    terms, sound = evaluate(["("] * 20_000 + ["mit"] + [")"] * 20_000)
    assert terms.text == "mit" and sound
    terms, sound = evaluate(["mit", "or"] * 100_000 + ["mit"])
    assert len(terms.text) == 7 * 100_000 + 3 and sound
    terms, sound = evaluate(["mit", "or", "("] * 20_000 + ["isc"] + [")"] * 20_000)
    assert terms.level == 1 and sound


def test_expressions_against_python():
    """Random bracketed expressions against Python's own and/or on class numbers."""
    rng = random.Random(3)
    names = {"0bsd": 0, "mit": 1, "mpl-2.0": 2, "gpl-2.0": 3, "sspl-1.0": 4}

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            name = rng.choice(list(names))
            return name, names[name]
        a, b = make(depth - 1), make(depth - 1)
        op = rng.choice(["and", "or"])
        return f"({a[0]} {op} {b[0]})", (max if op == "and" else min)(a[1], b[1])

    for _ in range(200):
        text, level = make(4)
        assert value(text)[1] == level


def test_statements_of_a_text():
    found = scan_text(
        "# SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib */\nfree under the MIT License "
        "or the Apache License, Version 2.0.\nAll rights reserved"
    )
    assert [t.text for t, _ in found.tagged] == ["(mit OR apache-2.0) AND zlib"]
    assert [t.text for t in found.noticed] == ["mit OR apache-2.0", "proprietary"]
    # Of overlapping notices the longest counts; the base phrase inside it stays.
    found = scan_text("the GNU general public license version 3")
    assert [n[2] for n in found.notices] == ["gpl-3.0"] and found.base == [(1, "gpl")]


def test_rows_against_brute_force(spark, documents):
    rng = random.Random(8)
    bits = ["MIT License", "mit", "license", "cc", "by", "CC-BY", "Apache\nLicense", "the", "é",
            "gnu general public", "gnu general public license", "\x00", "apache license", "cc by cc by"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(120)]
    texts += ["", None, "mit license " * 30_000, "ccby", "cc.by", texts[0], texts[0]]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)] + [(1, texts[1])]
    docs = documents(rows).selectExpr("*", "'x' AS labels", "1 AS n_words", "2 AS score")
    out = scan_licenses(docs).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels")
    got = sorted(((r.doc_id, *(r[n] for n in names)) for r in out), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=repr)
    for r in out:
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)
        assert r.labels == ",".join(sorted(set(r.labels.split(","))))


def test_empty_table(documents):
    assert scan_licenses(documents([])).collect() == []
