"""Collocations against brute force, over forced places and hot words."""

import random
import re
from collections import Counter

import pytest
from llm_texts import documents  # noqa: F401

from gridsieve.llm import collocations as col

NAMES = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, least, first):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for i in range(len(w)):
                for k in range(1, 6):
                    if i + k <= len(w):
                        f[lang, tuple(w[i : i + k])] += 1
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = Counter()
    for (lang, w), a in often.items():
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                if j - i < len(w):
                    inside[lang, w[i:j]] = max(inside[lang, w[i:j]], a)
    out = {}
    for (lang, w), a in often.items():
        if inside[lang, w] >= a:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[lang, w[:k]], f[lang, w[k:]]
            cuts.append((1000 * a * n[lang] // (l * r), k, l, r))
        s, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-s, -a, " ".join(w).encode(), l, r))
    rows = []
    for lang, found in out.items():
        for k, (s, a, phrase, l, r) in enumerate(sorted(found)[:first], 1):
            rows.append((lang, k, phrase.decode(), -a, l, r, n[lang], -s))
    return sorted(rows)


def mined(df, **kw):
    return sorted(tuple(r[c] for c in NAMES) for r in col.collocations(df, **kw).collect())


def made(rng, n):
    words = ["the", "of", "New", "york", "city", "a\x01", "a", "\x05", "é", "ß", "x" * 30, "b\x0b"]
    out = []
    for k in range(n):
        text = []
        for _ in range(rng.randrange(60)):
            text.append("new york city hall desk" if rng.random() < 0.05 else rng.choice(words))
            text.append(rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "!?"]))
        out.append((rng.choice(["en", "en", "de", None]), "".join(text)))
    return out


@pytest.mark.parametrize(
    "place_words, coded, first", [(50, 3, 2000), (2_000, 200, 50), (400_000, 1 << 18, 7)]
)
def test_rows_equal_brute_force(spark, monkeypatch, place_words, coded, first):
    monkeypatch.setattr(col, "SAMPLED", 7)
    monkeypatch.setattr(col, "AT_ONCE", 50_000)
    rows = made(random.Random(4), 300)
    rows += [("en", None), (None, ""), ("fr", "one two. three"), rows[0], rows[0]]
    rows += [("en", "the of " * 20_000), ("de", "x" * 100_000)]
    df = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    df = df.selectExpr("*", "'q' AS phrase", "1 AS n", "2 AS gram", "3 AS f")
    made_words = {w for _, t in rows for w in (t or "").split()}
    assert len(made_words) > 10
    got = mined(df, least=6, first=first, place_words=place_words, coded_words=coded)
    assert got == brute(rows, 6, first) and len(got) > 10


def test_exact_arithmetic_and_ties():
    # Counted by hand: the same score for both cuts takes the first.
    rows = [("en", "a b c")] * 10
    assert brute(rows, 10, 5) == [("en", 1, "a b c", 10, 10, 10, 30, 3000)]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "lang string, text string")
    assert mined(df) == []
    df = spark.createDataFrame([("en", None), (None, " . ")], "lang string, text string")
    assert mined(df) == []


def test_words_below_the_limit_are_cut():
    words = col.tokens(["A b.c  d\te", None, "f"])
    assert words == [b"a", b"b", b".", b"c", b"d", b"e", b".", b".", b"f"]
    codes, distinct = col._numbered(words)
    assert [distinct[k] if k >= 0 else None for k in codes] == [
        b"a", b"b", None, b"c", b"d", b"e", None, None, b"f"
    ]
