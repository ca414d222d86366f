"""Phrase collocations from a weighted de Bruijn graph of longest grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridsieve.llm.shingles import mix
from gridsieve.session import settle

LONGEST = 5
LEAST = 100
FIRST = 2000
NO_LANG = "und"
# Words of one place, the unit of work that a worker holds, and places of one partition (about).
PLACE_WORDS = 400_000
PLACES = 4
MOST_PARTITIONS = 20_000
# One position in SAMPLED is looked at to find beginnings too common for one place; there are
# at most three times MOST_SPREAD of them.
SAMPLED = 509
MOST_SPREAD = 30_000
# The most frequent words are written as one character each.
CODED_WORDS = 1 << 18
# Bits of the table of frequent words: this many for each word, up to a fixed size.
BITS_PER_WORD, MOST_BITS = 16, 1 << 27
# Characters of text handled at a time in a worker.
AT_ONCE = 3_000_000

# Characters that end a piece; inside a piece, space and tab end a word.
BREAKS = ".,;:!?\n\x0b\x0c\r"
_LETTERS = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
_FOLD = bytes.maketrans(
    _LETTERS[0] + BREAKS.encode() + b"\t", _LETTERS[1] + b"." * len(BREAKS) + b" "
)
# No word has these characters, so they set grams and words without a code apart.
_SPELLED, _SPELLED_END, _GRAM_END = "\x0c", "\t", "\n"
_FIRST_CODE, _SURROGATES, _BEYOND = 0x0E, (0xD800, 0x800), 0x110000


def tokens(texts: list[str | None]) -> list[bytes]:
    """Lower-cased words (A-Z only) of all texts; a dot stands at every end of a piece."""
    whole = ".".join(t or "" for t in texts).encode("utf-8", "surrogatepass")
    return whole.translate(_FOLD).replace(b".", b" . ").split()


def _by_lang(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list]]:
    """(lang, texts) of a bounded number of characters, or of one long text."""
    held: dict[str, list] = {}
    sizes: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, []).append(text.as_py())
            sizes[lang] = sizes.get(lang, 0) + len(held[lang][-1] or "")
            if sizes[lang] >= AT_ONCE:
                yield lang, held.pop(lang)
                sizes.pop(lang)
            elif sum(sizes.values()) >= 2 * AT_ONCE:
                yield from held.items()
                held, sizes = {}, {}
    yield from held.items()


def _numbered(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words and the distinct words; the code of a piece's end is -1."""
    held = np.empty(len(words), dtype=object)
    held[:] = words
    codes, distinct = pd.factorize(held)
    ends = np.array([w == b"." for w in distinct], dtype=bool)
    if ends.any():
        codes = np.where(codes == np.flatnonzero(ends)[0], -1, codes)
    return codes, distinct


def _told(words: np.ndarray) -> list[str]:
    return [w.decode("utf-8", "surrogatepass") for w in words]


def _hashes(lang: str, distinct: np.ndarray) -> np.ndarray:
    words = pd.util.hash_array(distinct, categorize=False).astype(np.uint64)
    seed = pd.util.hash_array(np.array([lang], dtype=object), categorize=False)[0]
    return mix(words ^ np.uint64(seed))


def word_counts(docs: DataFrame) -> DataFrame:
    """kind, lang, word, f: "word" every word, "all" the words of the lang, "sample" the grams
    of up to ``LONGEST - 1`` words at one position in ``SAMPLED``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _by_lang(batches):
            codes, distinct = _numbered(tokens(texts))
            words = _told(distinct)
            sampled = []
            for at in range(SAMPLED // 2, len(codes) - 1, SAMPLED):
                gram = codes[at : at + LONGEST - 1].tolist()
                gram = gram[: gram.index(-1)] if -1 in gram else gram
                if len(gram) > 1:
                    sampled.append(" ".join(words[k] for k in gram))
            codes = codes[codes >= 0]
            f = np.bincount(codes, minlength=len(distinct))
            seen = np.flatnonzero(f).tolist()
            kinds = ["word"] * len(seen) + ["all"] + ["sample"] * len(sampled)
            told = [*(words[k] for k in seen), "", *sampled]
            weights = np.concatenate((f[seen], [len(codes)], np.ones(len(sampled), np.int64)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array([lang] * len(told)), pa.array(told), pa.array(weights)],
                names=["kind", "lang", "word", "f"],
            )

    counted = docs.mapInArrow(count, "kind string, lang string, word string, f bigint")
    return counted.groupBy("kind", "lang", "word").agg(F.sum("f").alias("f"))


def _word_bits(frequent: DataFrame) -> np.ndarray:
    """A table of bits, one set for each frequent word.

    It grows with the words up to ``MOST_BITS`` (16 MB); a word that shares its bit with a
    frequent one only costs time.
    """
    words = frequent.count()
    bits = min(MOST_BITS, 1 << max(17, int(words * BITS_PER_WORD).bit_length()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            raw = np.empty(batch.num_rows, dtype=object)
            raw[:] = [w.encode("utf-8", "surrogatepass") for w in batch.column(1).to_pylist()]
            at = [_hashes(lang, raw[langs == lang]) % np.uint64(bits) for lang in set(langs)]
            at = np.unique(np.concatenate(at).astype(np.int64)) if at else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(at >> 16), pa.array((at & 0xFFFF).astype(np.int32))],
                names=["block", "bit"],
            )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for some in batch.column(1):
                mask = np.zeros(1 << 16, dtype=bool)
                mask[some.values.to_numpy()] = True
                out.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary())], names=["block", "bytes"]
            )

    blocks = frequent.select("lang", "word").mapInArrow(place, "block bigint, bit int")
    blocks = blocks.groupBy("block").agg(F.collect_set("bit").alias("bits"))
    table = np.zeros(bits // 8, dtype=np.uint8)
    for row in blocks.mapInArrow(packed, "block bigint, bytes binary").toLocalIterator():
        at = row["block"] << 13
        table[at : at + (1 << 13)] = np.frombuffer(row["bytes"], dtype=np.uint8)
    return table


def _code(rank: int) -> int:
    code = _FIRST_CODE + rank
    return code + _SURROGATES[1] if code >= _SURROGATES[0] else code


@dataclass
class Plan:
    """What every worker knows: all of it bounded by parameters, not by the texts."""

    bits: np.ndarray
    coded: dict[str, list[str]]  # the most frequent words of each language, in order of code
    spread: dict[str, set[str]]  # beginnings whose grams go to many places
    places: int

    def numbers(self, lang: str) -> dict[str, int]:
        return {w: _code(k) for k, w in enumerate(self.coded.get(lang, ()))}


def longest_grams(docs: DataFrame, plan: Plan) -> DataFrame:
    """place, lang, n, grams, twice: the edges of the graph, many to a row.

    From every word a gram goes on for ``LONGEST`` words; the end of a piece or a word below
    the limit cuts it short, and a gram of one word is no edge.  Grams that share their first
    two words have the same place, or their first three or four if fewer are too common, so
    each place gets its share.  A row holds the ``n`` distinct grams of one place and stretch
    of text; ``twice`` has (index, weight) of those found more than once.
    """
    held = docs.sparkSession.sparkContext.broadcast(plan)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, known_numbers = held.value, {}
        for lang, texts in _by_lang(batches):
            codes, distinct = _numbered(tokens(texts))
            if not len(codes):
                continue
            hashes = _hashes(lang, distinct)
            at = (hashes % np.uint64(len(plan.bits) * 8)).astype(np.int64)
            known = (plan.bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            codes = np.where(known[codes] & (codes >= 0), codes, -1)
            if lang not in known_numbers:
                known_numbers[lang] = plan.numbers(lang)
            numbers, words = known_numbers[lang], _told(distinct)
            written = pa.array(
                [chr(numbers[w]) if w in numbers else _SPELLED + w + _SPELLED_END for w in words]
            )
            padded = np.concatenate((codes, np.full(LONGEST, -1)))
            n = len(codes)
            start = np.flatnonzero((padded[:n] >= 0) & (padded[1 : n + 1] >= 0))
            if not len(start):
                continue
            made, key = written.take(pa.array(codes[start])), hashes[codes[start]]
            alive, loose = np.ones(len(start), bool), np.ones(len(start), bool)
            for k in range(1, LONGEST):
                nxt = padded[start + k]
                alive &= nxt >= 0
                step = written.take(pa.array(nxt, mask=~alive))
                made = pc.binary_join_element_wise(made, step, "", null_handling="skip")
                grow = alive & loose
                key = np.where(grow, mix(key * np.uint64(31) + hashes[np.where(alive, nxt, 0)]), key)
                loose = grow & _common(plan.spread.get(lang), words, padded, start, k, grow)
            place = (key % np.uint64(plan.places)).astype(np.int32)
            rows = pa.table({"place": place, "gram": made})
            rows = rows.group_by(["place", "gram"], use_threads=False)
            yield from _packed(lang, rows.aggregate([([], "count_all")]))

    return docs.mapInArrow(
        cut, "place int, lang string, n int, grams binary, twice binary"
    )


def _common(spread, words, padded, start, k, among) -> np.ndarray:
    """Whether the first k + 1 words of a gram are in ``spread``, for the grams ``among``."""
    out = np.zeros(len(start), dtype=bool)
    if not spread or k + 1 >= LONGEST:
        return out
    numbers = {w: i for i, w in enumerate(words)}
    for phrase in spread:
        parts = [numbers.get(w) for w in phrase.split(" ")]
        if len(parts) == k + 1 and None not in parts:
            rows = among.copy()
            for j, part in enumerate(parts):
                rows[rows] = padded[start[rows] + j] == part
            out |= rows
    return out


def _packed(lang: str, rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """One row for each place, its grams one after another."""
    order = np.argsort(rows.column("place").to_numpy(), kind="stable")
    place = rows.column("place").to_numpy()[order]
    weight = rows.column("count_all").to_numpy()[order]
    grams = rows.column("gram").combine_chunks().take(pa.array(order))
    ended = pc.binary_join_element_wise(grams, "", _GRAM_END)
    offsets = np.frombuffer(ended.buffers()[1], dtype=np.int32)[: len(ended) + 1]
    edges = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
    blobs = pa.Array.from_buffers(
        pa.binary(), len(edges) - 1, [None, pa.py_buffer(offsets[edges].copy()), ended.buffers()[2]]
    )
    twice = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        at = np.flatnonzero(weight[a:b] > 1)
        twice.append(np.stack((at, weight[a:b][at])).astype("<i8").tobytes())
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(place[edges[:-1]]), pa.array([lang] * (len(edges) - 1)),
            pa.array(np.diff(edges).astype(np.int32)), blobs, pa.array(twice, pa.binary()),
        ],
        names=["place", "lang", "n", "grams", "twice"],
    )


def _unpacked(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """Matrix of word numbers (0 beyond a gram's end), weights, and the words without a code."""
    text = b"".join(r["grams"] for r in rows).decode("utf-8", "surrogatepass")
    weight = np.ones(sum(r["n"] for r in rows), dtype=np.int64)
    at = 0
    for r in rows:
        if r["twice"]:
            where, f = np.frombuffer(r["twice"], dtype="<i8").reshape(2, -1)
            weight[at + where] = f
        at += r["n"]
    signs = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    spelled: dict[str, int] = {}
    begin = np.flatnonzero(signs == ord(_SPELLED))
    if len(begin):
        end = np.flatnonzero(signs == ord(_SPELLED_END))
        for a, b in zip(begin.tolist(), end.tolist()):
            signs[a] = spelled.setdefault(text[a + 1 : b], _BEYOND + len(spelled))
        inside = np.zeros(len(signs) + 1, dtype=np.int8)
        inside[begin + 1] += 1
        inside[end + 1] -= 1
        signs = signs[np.cumsum(inside[:-1]) == 0]
    ends = np.flatnonzero(signs == ord(_GRAM_END))
    size = np.diff(ends, prepend=-1) - 1
    matrix = np.zeros((len(ends), LONGEST), dtype=np.int64)
    matrix[np.arange(LONGEST) < size[:, None]] = signs[signs != ord(_GRAM_END)]
    return matrix, weight, {v: w for w, v in spelled.items()}


def _flows(least: int, held):
    """Counts of all grams that begin an edge, place by place, by sorted prefix sums.

    A node's count is what flows out of it along its edges, plus the edges that end with it
    as a piece does.  Sorted by words, the edges of a node are neighbours; the changes of each
    column are OR-ed onto those before it, and reduceat adds the weights up.  Beginnings that
    are spread over places have only a part of their sum here, so it is passed on as it is.
    """
    numbers: dict[str, dict[str, int]] = {}

    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, at = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if rows and (row["place"], row["lang"]) != at:
                    yield from sums(rows)
                    rows = []
                at = row["place"], row["lang"]
                rows.append(row)
        if rows:
            yield from sums(rows)

    def sums(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        plan, lang = held.value, rows[0]["lang"]
        if lang not in numbers:
            numbers[lang] = plan.numbers(lang)
        matrix, weight, spelled = _unpacked(rows)
        rows.clear()
        number = {**numbers[lang], **{w: k for k, w in spelled.items()}} if spelled else numbers[lang]
        spread = [[number.get(w) for w in p.split(" ")] for p in plan.spread.get(lang, ())]
        spread = {tuple(p) for p in spread if None not in p}
        pairs = np.array([p[0] << 32 | p[1] for p in spread], dtype=np.int64)
        m = matrix
        order = np.lexsort((m[:, 4], m[:, 2] << 32 | m[:, 3], m[:, 0] << 32 | m[:, 1]))
        matrix, weight = m[order], weight[order]
        mask = np.zeros(len(matrix), dtype=bool)
        mask[:1] = True
        for j in range(LONGEST):
            mask[1:] |= matrix[1:, j] != matrix[:-1, j]
            if not j:
                continue
            marks = np.flatnonzero(mask)
            f = np.add.reduceat(weight, marks)
            real = matrix[marks, j] > 0
            keep = real & (f >= least)
            if len(pairs) and j + 1 < LONGEST:
                first = matrix[marks, 0] << 32 | matrix[marks, 1]
                for k in np.flatnonzero(real & ~keep & np.isin(first, pairs)).tolist():
                    keep[k] = tuple(matrix[marks[k], : j + 1].tolist()) in spread
            if not keep.any():
                continue
            found = matrix[marks[keep], : j + 1].tolist()
            words = dict(spelled)
            coded = plan.coded.get(lang, [])
            for v in {v for g in found for v in g} - words.keys():
                words[v] = coded[v - (_SURROGATES[1] if v >= sum(_SURROGATES) else 0) - _FIRST_CODE]
            grams = [" ".join(words[v] for v in g) for g in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(grams)), pa.array(grams),
                    pa.array(np.full(len(grams), j + 1, dtype=np.int32)), pa.array(f[keep]),
                ],
                names=["lang", "gram", "k", "f"],
            )

    return flows


def _spread_beginnings(samples: DataFrame, place_words: int) -> dict[str, set[str]]:
    """Phrases of 2 to ``LONGEST - 1`` words that begin over a quarter of a place's grams, by
    the sample; a wrong guess costs balance, nothing else."""
    total = samples.agg(F.sum("f")).first()[0] or 0
    common = max(2, place_words // (4 * SAMPLED), total // MOST_SPREAD)
    words = F.split("word", " ")
    starts = F.explode(
        F.transform(
            F.sequence(F.lit(2), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " ")
        )
    )
    begun = samples.select("lang", "f", starts.alias("start")).groupBy("lang", "start")
    found: dict[str, set[str]] = {}
    for row in begun.agg(F.sum("f").alias("f")).where(F.col("f") >= common).collect():
        found.setdefault(row["lang"], set()).add(row["start"])
    return found


def phrase_counts(
    docs: DataFrame, least: int = LEAST, place_words: int = PLACE_WORDS,
    coded_words: int = CODED_WORDS,
) -> tuple[DataFrame, DataFrame]:
    """Settled tables: (lang, gram, k, f) of all grams of up to ``LONGEST`` words with f of at
    least ``least``, and (lang, n).  ``docs`` has lang and text.

    Broadcast are the bit table (16 MB at most), ``coded_words`` words and the spread
    beginnings, whose numbers are bounded by parameters.
    """
    spark = docs.sparkSession
    words = settle(word_counts(docs), "words")
    totals = settle(words.where("kind = 'all'").select("lang", F.col("f").alias("n")), "totals")
    frequent = words.where((F.col("kind") == "word") & (F.col("f") >= least))
    total = totals.agg(F.sum("n")).first()[0] or 0
    partitions = max(
        int(spark.conf.get("spark.sql.shuffle.partitions")),
        min(MOST_PARTITIONS, -(-total // (place_words * PLACES))),
    )
    places = max(partitions * PLACES, -(-total // place_words))
    coded: dict[str, list[str]] = {}
    top = frequent.orderBy(F.desc("f"), "lang", "word").limit(coded_words)
    for row in top.select("lang", "word").collect():
        coded.setdefault(row["lang"], []).append(row["word"])
    spread = _spread_beginnings(words.where("kind = 'sample'"), place_words)
    plan = Plan(_word_bits(frequent), coded, spread, places)
    grams = longest_grams(docs, plan).repartition(partitions, "place")
    grams = grams.sortWithinPartitions("place", "lang")
    flowed = grams.mapInArrow(
        _flows(least, spark.sparkContext.broadcast(plan)),
        "lang string, gram string, k int, f bigint",
    )
    summed = settle(flowed, "flows").groupBy("lang", "gram", "k").agg(F.sum("f").alias("f"))
    single = frequent.select("lang", F.col("word").alias("gram"), F.lit(1).alias("k"), "f")
    counts = summed.where(F.col("f") >= least).unionByName(single)
    return settle(counts, "counts"), totals


def _joined(parts):
    return F.array_join(parts, " ")


def collocations(
    docs: DataFrame, least: int = LEAST, first: int = FIRST, lang_col: str = "lang",
    text_col: str = "text", place_words: int = PLACE_WORDS, coded_words: int = CODED_WORDS,
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the ``first`` best phrases of each language.

    Phrases have 2 to ``LONGEST`` words and a >= ``least``.  The score is that of the worst cut
    in two, in exact decimals.  A phrase whose node lies on a unary path of the graph (one edge
    into or out of it carries its whole weight) is compacted into the longer one and goes.

    Null texts are empty, null languages are "und"; rows repeated count again; texts without
    words add nothing; an empty table gives no rows; other columns are not read.
    """
    picked = docs.select(
        F.coalesce(F.col(lang_col), F.lit(NO_LANG)).alias("lang"), F.col(text_col).alias("text")
    )
    counts, totals = phrase_counts(picked, least, place_words, coded_words)
    phrases = counts.where("k >= 2").withColumn("w", F.split("gram", " "))

    # Compaction: an edge that carries the whole weight of one of its two nodes.
    edges = phrases.where("k >= 3")
    inner = edges.select(
        "lang", "f",
        F.explode(
            F.array(
                _joined(F.slice("w", F.lit(1), F.col("k") - 1)),
                _joined(F.slice("w", F.lit(2), F.col("k") - 1)),
            )
        ).alias("gram"),
    ).distinct()
    kept = phrases.join(inner, ["lang", "gram", "f"], "left_anti")

    cut_at = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at")
    cuts = kept.select("lang", "gram", F.col("f").alias("a"), "w", "k", cut_at)
    cuts = cuts.select(
        "lang", "gram", "a", "at",
        _joined(F.slice("w", F.lit(1), F.col("at"))).alias("left"),
        _joined(F.slice("w", F.col("at") + 1, F.col("k") - F.col("at"))).alias("right"),
    )
    of = counts.select("lang", "gram", "f")
    cuts = cuts.join(of.toDF("lang", "left", "l"), ["lang", "left"]).join(
        of.toDF("lang", "right", "r"), ["lang", "right"]
    )
    cuts = cuts.join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    over = (exact("a") * exact("n")).cast("decimal(35,0)") * F.lit(1000).cast("decimal(4,0)")
    cuts = cuts.withColumn("over", over.cast("decimal(38,0)")).withColumn(
        "under", (exact("l") * exact("r")).cast("decimal(38,0)")
    )
    cuts = cuts.withColumn("score", F.expr("over div under"))
    worst = cuts.groupBy("lang", "gram").agg(
        F.min(F.struct("score", "at", "a", "l", "r", "n")).alias("c")
    )
    scored = worst.select("lang", F.col("gram").alias("phrase"), "c.a", "c.l", "c.r", "c.n", "c.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
    ranked = ranked.where(F.col("rank") <= first)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


COLLOCATIONS_SQL = r"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS piece, p FROM (
    SELECT lang, unnest(regexp_split_to_array(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)),
words AS (SELECT lang, piece, unnest(w) AS word, generate_subscripts(w, 1) AS spot
  FROM (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces)),
runs AS (SELECT lang, word AS w1, lead(word, 1) OVER v AS w2, lead(word, 2) OVER v AS w3,
  lead(word, 3) OVER v AS w4, lead(word, 4) OVER v AS w5 FROM words
  WINDOW v AS (PARTITION BY piece ORDER BY spot)),
total AS (SELECT lang, count(*) AS n FROM words GROUP BY lang),
gram AS (
  SELECT lang, [w1] AS g, count(*) AS f FROM runs GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2], count(*) FROM runs WHERE w2 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3], count(*) FROM runs WHERE w3 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) FROM runs WHERE w4 IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) FROM runs WHERE w5 IS NOT NULL
    GROUP BY ALL),
often AS (SELECT * FROM gram WHERE f >= 100),
cand AS (SELECT * FROM often WHERE len(g) >= 2),
inside AS (SELECT DISTINCT o.lang, o.f, o.g[i:j] AS g
  FROM cand o, unnest(range(1, len(g) + 1)) AS u(i), unnest(range(1, len(g) + 1)) AS v(j)
  WHERE j > i AND j - i + 1 < len(o.g)),
holder AS (SELECT lang, g, max(f) AS f FROM inside GROUP BY lang, g),
kept AS (SELECT c.* FROM cand c LEFT JOIN holder h USING (lang, g)
  WHERE h.f IS NULL OR h.f < c.f),
cut AS (SELECT k.lang, k.g, k.f AS a, i, l.f AS l, r.f AS r, n,
    CAST(1000::HUGEINT * k.f * n // (l.f::HUGEINT * r.f) AS BIGINT) AS score
  FROM kept k, unnest(range(1, len(k.g))) AS u(i), often l, often r, total t
  WHERE l.lang = k.lang AND l.g = k.g[1:i] AND r.lang = k.lang AND r.g = k.g[i + 1:]
    AND t.lang = k.lang),
worst AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, i) = 1),
ranked AS (SELECT lang, array_to_string(g, ' ') AS phrase, a, l, r, n, score FROM worst)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
    AS BIGINT) AS rank, phrase, a, l, r, n, score
FROM ranked QUALIFY rank <= 2000"""
