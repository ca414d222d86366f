"""Token ids, Simple-8b files and packing against direct encoding and exact round trips."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_texts import documents  # noqa: F401

from gridsieve.llm import packing, simple8b
from gridsieve.llm.token_files import pack_block, token_file_digest, unpack_block
from gridsieve.llm.tokens import PieceTokenizer

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
PATHS = {n: public_tokenizers.path(n) for n in NAMES}
CACHED = {n: PieceTokenizer(PATHS[n], keep=50) for n in NAMES}
DIRECT = {n: Tokenizer.from_file(PATHS[n]) for n in NAMES}
for t in DIRECT.values():
    t.encode_special_tokens = True

ODD = st.text(
    alphabet=st.one_of(
        st.sampled_from("ab'sté.,#1  \n\t\x85\xa0　\x1c\x1f́;K<>|_​"),
        st.characters(codec="utf-8"),
    ),
    max_size=40,
)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=400, deadline=None)
@given(text=ODD)
def test_pieces_give_the_ids_of_the_whole(name, text):
    want = DIRECT[name].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(CACHED[name]([text])[0], "<u4").tolist() == want


@pytest.mark.parametrize("name", NAMES)
def test_stretches_of_plain_texts(name):
    """Words, marks and line ends in all neighbourhoods, over several generations."""
    rng = random.Random(2)
    words = ["The", "don't", "é,", "(a)", "x1", "\"q\"", "end.", "ä́", "\x1cz", "a\tb", "\u3000", "'s"]
    words += [f"word{k}" for k in range(300)] + [f"Wört{k}," for k in range(100)]
    texts = [
        "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\n", "\n\n", "  ", " \n", ""])
                for _ in range(rng.randrange(200)))
        for _ in range(60)
    ]
    texts += [" ".join(rng.choice(words[:7]) for _ in range(50)) for _ in range(20)]
    want = [DIRECT[name].encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):
        got = [np.frombuffer(b, "<u4").tolist() for t in texts for b in CACHED[name]([t])]
        assert got == want


@settings(max_examples=200, deadline=None)
@given(
    st.lists(
        st.one_of(
            st.integers(0, 1), st.integers(0, 50_000), st.integers(0, 2**64 - 1), st.just(0)
        ),
        max_size=400,
    )
)
def test_simple8b_round_trip(values):
    words = simple8b.encode(np.array(values, dtype=np.uint64))
    assert simple8b.decode(words, len(values)).tolist() == values


def test_simple8b_packs():
    assert len(simple8b.encode(np.zeros(240))) == 2
    assert len(simple8b.encode(np.full(30, 1 << 14))) == 8
    assert len(simple8b.encode(np.array([1 << 63], dtype=np.uint64))) == 2


def test_block_round_trip():
    docs = [np.array(v, "<u4").tobytes() for v in ([1], [5, 6, 70_000], [], [1] * 300)]
    lengths, ids = unpack_block(pack_block(docs))
    assert lengths.tolist() == [1, 3, 0, 300] and ids.tobytes() == b"".join(docs)


def _rows(rng):
    rows = [(3, "The end."), (1, None), (2, ""), (3, "The end."), (None, "no id"), (9, "x y")]
    rows += [(100 + i, " ".join(rng.choice(["a", "of", "zq"]) for _ in range(i))) for i in range(80)]
    return rows + [(500, "long word " * 4000), (7, "0 <|endoftext|> end")]


def _ids(name, text):
    return DIRECT[name].encode(text or "", add_special_tokens=False).ids + [1]


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, documents):
    rows = _rows(random.Random(1))
    got = token_file_digest(documents(rows), PATHS[NAMES[0]]).collect()
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = _ids(NAMES[0], t)
        want.append((d, start, len(ids), _crc(ids)))
        start += len(ids)
    key = lambda r: r[1]
    assert sorted(map(tuple, got), key=key) == want
    assert token_file_digest(documents([]), PATHS[NAMES[0]]).count() == 0


def test_packing(spark, documents):
    rows = _rows(random.Random(2))
    got = packing.pack_documents(documents(rows), PATHS[NAMES[1]]).collect()
    from collections import Counter, defaultdict

    want = Counter((d, tuple(_ids(NAMES[1], t))) for d, t in rows)
    sequences, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append(r)
        by_doc[r.doc_id, r.doc_tokens].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and at & (at - 1) == 0
    for (d, ids), n in want.items():
        parts = by_doc[d, len(ids)]
        assert sum(r.length for r in parts) == n * len(ids)
        for r in parts:
            assert r.ids_crc32 == _crc(ids[r.start : r.start + r.length])
    assert packing.pack_documents(documents([]), PATHS[NAMES[1]]).count() == 0


def test_least_squares_plan():
    histogram = np.zeros(16)
    histogram[[4, 12, 8, 5]] = [10, 10, 6, 7]
    combos = packing.combinations(histogram)
    assert (4, 12) in combos and (8, 8) in combos and (4, 4, 8) in combos
    x = packing.nonnegative_least_squares(combos, histogram)
    a = np.zeros((16, len(combos)))
    for j, c in enumerate(combos):
        for n in c:
            a[n, j] += 1
    slope = a.T @ (a @ x - histogram)
    assert (x >= 0).all() and (slope > -0.05).all() and (np.abs(slope[x > 0]) < 0.05).all()


UNTOUCHED = {n: Tokenizer.from_file(PATHS[n]) for n in NAMES}
ADDED = {n: PieceTokenizer(PATHS[n], keep=50, added_tokens=True) for n in NAMES}
MARKED = st.lists(st.one_of(ODD, st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "a"])), max_size=8)


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=300, deadline=None)
@given(parts=MARKED)
def test_added_tokens_give_the_ids_of_the_untouched_tokenizer(name, parts):
    text = "".join(parts)
    want = UNTOUCHED[name].encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ADDED[name]([text])[0], "<u4").tolist() == want


def test_registered_queries_keep_added_tokens(spark, documents, tmp_path):
    from gridsieve.llm import queries

    text = "0 <|endoftext|> end <|startoftext|>"
    documents([(7, text)]).write.parquet(f"{tmp_path}/documents.parquet")
    want = [UNTOUCHED[n].encode(text, add_special_tokens=False).ids + [1] for n in NAMES]
    assert 49407 in want[0] and 49406 in want[0] and 50256 in want[1]
    (row,) = queries.QUERIES["op5_token_files"](spark, str(tmp_path)).collect()
    assert (row.n_tokens, row.ids_crc32) == (len(want[0]), _crc(want[0]))
    pieces = sorted(queries.QUERIES["op9_packing"](spark, str(tmp_path)).collect(), key=lambda r: r.start)
    assert {r.doc_tokens for r in pieces} == {len(want[1])}
    assert [r.ids_crc32 for r in pieces] == [_crc(want[1][r.start : r.start + r.length]) for r in pieces]


def test_blocks_are_read_without_a_shuffle(spark, tmp_path):
    from gridsieve.llm.token_files import read_token_files, write_token_files

    docs = spark.createDataFrame([(i, f"word {i}") for i in range(20)], "doc_id long, text string")
    path = str(tmp_path / "blocks")
    write_token_files(docs, path, public_tokenizers.path("word_bpe_49k.json"), 1)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    # A table of blocks whose bases are believed to be large.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = read_token_files(spark, path)
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert sorted(r.doc_id for r in back.collect()) == list(range(20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_one_piece_serves_both_cases():
    """A word is learnt once, however it is written; texts beyond Latin-1 keep their case."""
    name = "word_bpe_49k.json"
    cached = PieceTokenizer(PATHS[name], added_tokens=True)
    cached(["Été ÉTÉ été", "Word word WORD"])
    assert {p for p in cached._known if p.isalpha()} == {"été", "word"}
    whole = Tokenizer.from_file(PATHS[name])
    texts = ["1<|ENDOFTEXT|>", "1<|EndOfText|> <|endoftext|>X", "ΟΔΟΣ Word", "İX", "µßÿÆ×÷", "ÀB1Cd don'T"]
    for t in texts:
        got = np.frombuffer(cached([t])[0], "<u4").tolist()
        assert got == whole.encode(t, add_special_tokens=False).ids, t


LATIN_1 = st.lists(
    st.one_of(
        st.none(),
        st.text(alphabet=st.sampled_from("aBé's.,#1  \n\t\x85\xa0\x1cß×ª(|<"), max_size=30),
        st.text(alphabet=st.characters(max_codepoint=255), max_size=40),
        st.sampled_from(["<|endoftext|>", "x<|ENDOFTEXT|>y", "a\0b", "Ā b", "W" * 40 + ", 'tis " + "-" * 17]),
    ),
    max_size=6,
)
FULL = {n: PieceTokenizer(PATHS[n]) for n in NAMES}


@pytest.mark.parametrize("name", NAMES)
@settings(max_examples=500, deadline=None)
@given(texts=LATIN_1)
def test_texts_cut_together_give_the_ids_of_each(name, texts):
    want = [DIRECT[name].encode(t or "", add_special_tokens=False).ids for t in texts]
    for cached in (CACHED[name], FULL[name]):
        assert [np.frombuffer(b, "<u4").tolist() for b in cached(texts)] == want
    want = [UNTOUCHED[name].encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(b, "<u4").tolist() for b in ADDED[name](texts)] == want


@pytest.mark.parametrize("name", NAMES)
def test_latin_1_texts_take_no_step_for_each_piece(name, monkeypatch):
    cached = PieceTokenizer(PATHS[name], added_tokens=True)
    text = "It was a word, wasn't it?\n\nÉté (12) " * 50
    want = cached([text])
    monkeypatch.setattr(cached, "_cut", None)
    assert cached([text, "", text]) == [want[0], b"", want[0]]


def test_remembered_pieces_take_little_memory():
    """60,000 words: 7.3 MB as strings and bytes in a dictionary."""
    import tracemalloc

    cached = PieceTokenizer(PATHS[NAMES[1]])
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:60_000]
    texts = [" ".join(words[at : at + 1000]) for at in range(0, len(words), 1000)]
    tracemalloc.start()
    try:
        for t in texts:
            cached([t])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(cached._known) > 55_000
    assert held < 5.5e6


def test_pieces_not_met_again_are_forgotten():
    cached = PieceTokenizer(PATHS[NAMES[0]], keep=100)
    for k in range(40):
        cached([f"same {' '.join(f'{chr(97 + k // 26)}{chr(97 + k % 26)}{chr(97 + j)}' for j in range(20))}"])
        assert len(cached._known) <= 100 + 21
        assert "same" in cached._known
