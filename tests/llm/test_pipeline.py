"""Every stage of the pipeline against brute force on its own input, and odd tables."""

import hashlib
import random
import shutil
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm_texts import made_text
from pyspark.sql import functions as F
from test_dart_minhash import brute as brute_classes
from test_decontamination import words_of as plain_words
from test_substring_index import brute as brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline as cp
from gridsieve.llm import quality_votes as qv
from gridsieve.llm.shingles import words_of
from gridsieve.session import settle

EXTRA = {"label": "bigint", "spans": "string", "digest": "string", "m": "bigint", "h": "bigint"}


def _planted(rows, items):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(3000)]
    long = [made_text(rng, n, vocabulary) for n in (80, 300, 900)]
    passage = made_text(rng, 60, vocabulary)
    texts = long + [t + " tail" for t in long] + [long[1]]
    texts += [made_text(rng, 120, vocabulary) + "\n" + passage + "\n" + made_text(rng, 90, vocabulary) for _ in range(3)]
    texts += [rows[3][1], rows[5][1], items[0], made_text(rng, 40, vocabulary) + " " + items[1]]
    planted = [(10**6 + k, t) for k, t in enumerate(texts)]
    planted += [planted[0], (None, long[2]), (None, long[2]), (None, "no id and a text of its own"), (None, None)]
    return planted + [(2 * 10**6, None), (2 * 10**6 + 1, ""), (2 * 10**6 + 2, " \n "), (2 * 10**6 + 3, passage)]


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """A folder of tables: planted rows and clashing columns in documents, the rest as given."""
    folder = tmp_path_factory.mktemp("tables")
    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf_dir}/{name}.parquet", folder / f"{name}.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    given = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy("item_id").collect()]
    full = [(d, t, "en", "src0", len(t or "")) for d, t in _planted(given, items)]
    more = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    both = docs.select(*[F.col(c).cast(t) for c, t in more.dtypes]).unionByName(more)
    both = both.withColumns({c: F.lit("7").cast(t) for c, t in EXTRA.items()})
    both.coalesce(3).write.parquet(str(folder / "documents.parquet"))
    return str(folder)


def _pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def _scores_by_hand(model, texts):
    """(score, whether the last neighbour is a tie) from dense vectors and all cosines."""
    for text in texts:
        dense = np.zeros(len(model.idf))
        buckets, counts = qv.features(text)
        dense[buckets] = (1 + np.log(counts)) * model.idf[buckets]
        v = dense @ model.basis.astype(np.float64)
        v = v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-12 else v
        cosines = model.vectors.astype(np.float64) @ v
        order = np.argsort(-cosines)
        k = min(qv.NEIGHBOURS, len(order))
        weights = np.clip(cosines[order[:k]], 0, 1) ** qv.SHARPNESS * model.votes[order[:k]]
        score = model.prior
        if weights.sum() > 1e-9:
            score = float((weights * model.labels[order[:k]]).sum() / weights.sum())
        tie = k < len(order) and abs(cosines[order[k - 1]] - cosines[order[k]]) < 1e-5
        yield score, tie


def _check_quality(spark, tables, before, after):
    labels = spark.read.parquet(f"{tables}/labels.parquet")
    rows = _pairs(before)
    model = qv.fit_votes(before, labels)
    kept = Counter(_pairs(after))
    clear = 0
    for row, (score, tie) in zip(rows, _scores_by_hand(model, [t for _, t in rows])):
        if not tie and abs(score - qv.ACCEPTED) > 1e-4:
            clear += 1
            assert (row in kept) == (score >= qv.ACCEPTED)
    assert clear > 0.8 * len(rows) and not kept - Counter(rows)


def _check_dedup(before, after):
    rows, kept = _pairs(before), _pairs(after)
    want = []
    for members in brute_classes(rows):
        ids = [int(m) for m in members if m != "None"]
        want.append(min(ids) if ids else None)
    assert sorted(map(str, want)) == sorted(str(d) for d, _ in kept)
    assert not set(kept) - set(rows)


def _check_repeats(before, after):
    # A document that loses all its words goes; one without words stays.
    rows = brute_repeats(_pairs(before))
    want = Counter((d, digest) for d, words, gone, digest in rows if not gone or gone < words)
    assert len(rows) > want.total()
    got = Counter((d, hashlib.sha256(b" ".join(words_of(t))).hexdigest()) for d, t in _pairs(after))
    assert got == want
    assert after.where("n_chars <> length(text)").count() == 0


def _check_benchmark(spark, tables, before, after):
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect():
        own = plain_words(r.text)
        m = min(13, len(own))
        windows[m] |= {tuple(own[k : k + m]) for k in range(len(own) - m + 1)}
    windows.pop(0, None)
    want = Counter()
    for row in _pairs(before):
        words, hit = plain_words(row[1]), set()
        for m, some in windows.items():
            for a in range(len(words) - m + 1):
                if tuple(words[a : a + m]) in some:
                    hit |= set(range(a, a + m))
        if not (hit and 20 * len(hit) >= len(words)):
            want[row] += 1
    assert Counter(_pairs(after)) == want


def _check_packing(before, after):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter((d, (*plain.encode(t or "", add_special_tokens=False).ids, 1)) for d, t in _pairs(before))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in after.collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in want}
    for own in sequences.values():
        ends = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == ends
            ends += r.length
        assert ends <= 2048
    for d, own in pieces.items():
        texts = [ids for (e, ids), n in want.items() if e == d for _ in range(n)]
        assert sum(r.length for r in own) == sum(map(len, texts))
        for r in own:
            cut = [np.array(ids[r.start : r.start + r.length], "<u4").tobytes() for ids in texts if len(ids) == r.doc_tokens]
            assert r.ids_crc32 in {zlib.crc32(c) for c in cut}


def test_stages_equal_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in cp.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "packing",
    ]
    sizes = [docs.count()]
    for name, stage in cp.STAGES:
        out = settle(stage(spark, docs, tables), name)
        if name == "quality_classifier":
            _check_quality(spark, tables, docs, out)
            # The planted rows go on whatever the classifier says of made-up words.
            lost = docs.where("doc_id >= 1000000 or doc_id is null").exceptAll(out)
            out = settle(out.unionByName(lost), "with-planted")
        elif name == "minhash_near_dedup":
            _check_dedup(docs, out)
        elif name == "substring_dedup":
            _check_repeats(docs, out)
        elif name == "benchmark_decontamination":
            _check_benchmark(spark, tables, docs, out)
        else:
            _check_packing(docs, out)
        if name != "packing":
            assert out.columns == docs.columns
            sizes.append(out.count())
        docs = out
    assert all(after < before for before, after in zip(sizes, sizes[1:]))


def test_empty_documents(spark, tables, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{tables}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
