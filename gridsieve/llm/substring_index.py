"""Exact substring deduplication with one FM-index per shard of repeated segments.

Windows of ``WINDOW`` words are dealt by their minimizer: the smallest hash among the
``GRAM``-word grams of a window, which equal windows share.  Consecutive windows with the same
minimizer form a segment.  Only segments whose minimizer occurs again can hold a repeat.
Segments with the same words (a form) are folded to the earliest; every later one is a repeat
in all its windows.  Forms that share a minimizer go to the same shard, where an FM-index over
their words is searched backwards with every window of the shard, and the suffix range gives
the earliest place of the same words.

A minimizer with very many forms (a short phrase in a third of all documents) is not sent to
a shard: its windows are compared by hash in a pre-aggregated join, which Spark can split.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.fm_index import FMIndex, earliest, matching_windows
from gridsieve.llm.memory import giving_back
from gridsieve.llm.shingles import mix, window_hashes, word_hashes, words_of
from gridsieve.session import settle, temporary_tables

WINDOW = 20
GRAM = 5
# Forms of one minimizer that may meet in a shard.
MOST_FORMS = 1000
# Bytes of a side that may be broadcast; a larger side is joined by a shuffle.
BROADCAST_BYTES = 48 * 1024 * 1024
# Rows that a task turns into Python objects at a time.
SLICE = 256
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

_SEGMENT = "mini bigint, form bigint, doc bigint, key bigint, tag bigint, start int, n int"


def row_key(doc: int | None, text: str | None) -> int:
    """A signed 64-bit key of a row: rows with the same id and text are alike."""
    raw = str(doc).encode() + b"\x00" + (text or "").encode("utf-8", "surrogatepass")
    return struct.unpack("<q", hashlib.blake2b(raw, digest_size=8).digest())[0]


def segments(hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(minimizer, form, first window, windows) of each segment of a text's word hashes."""
    if len(hashes) < WINDOW:
        none = np.empty(0, dtype=np.int64)
        return none, none, none, none
    grams = window_hashes(hashes, GRAM)
    place = sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1)
    place = place + np.arange(len(place))
    starts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    counts = np.diff(np.concatenate((starts, [len(place)])))
    # A form is the hash of the segment's words: of its grams, from a running sum.
    spread = mix(grams) * np.uint64(0x9E3779B97F4A7C15)
    power = np.cumprod(np.full(len(grams), 0xD6E8FEB86659FD93, dtype=np.uint64))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(mix(spread) * power, dtype=np.uint64)))
    last = starts + counts + WINDOW - GRAM
    inverse = _inverse_powers(len(grams))
    form = mix((sums[last] - sums[starts]) * inverse[starts] + counts.astype(np.uint64))
    return grams[place[starts]].astype(np.int64), form.astype(np.int64), starts, counts


def _inverse_powers(n: int) -> np.ndarray:
    inverse = pow(0xD6E8FEB86659FD93, -1, 2**64)
    return np.cumprod(np.full(n, inverse, dtype=np.uint64))


def _segments_of(rows: DataFrame) -> DataFrame:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                found, docs, keys, tags = [], [], [], []
                for doc, text, tag in zip(*(c.to_pylist() for c in part.columns)):
                    own = segments(word_hashes(words_of(text)))
                    if len(own[0]):
                        found.append(own)
                        docs.append(doc)
                        keys.append(row_key(doc, text))
                        tags.append(tag)
                if not found:
                    continue
                sizes = [len(f[0]) for f in found]
                mini, form, start, n = (np.concatenate(c) for c in zip(*found))
                owners = np.repeat(np.arange(len(docs)), sizes)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(mini, pa.int64()),
                        pa.array(form, pa.int64()),
                        pa.array(docs, pa.int64()).take(pa.array(owners)),
                        pa.array(np.array(keys, dtype=np.int64)[owners]),
                        pa.array(np.array(tags, dtype=np.int64)[owners]),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["mini", "form", "doc", "key", "tag", "start", "n"],
                )

    tagged = rows.select("doc", "text", _tag("doc", "text").alias("tag"))
    return tagged.mapInArrow(giving_back(cut), _SEGMENT)


def _tag(doc: str, text: str) -> Column:
    """A 64-bit hash that Spark finds rows by again, without a pass through Python."""
    return F.xxhash64(doc, text)


def _joined(big: DataFrame, small: DataFrame, on: list[str], how: str, row_bytes: int) -> DataFrame:
    """Join with a settled side: broadcast if its rows are within the limit, else shuffled."""
    held = small.count() * row_bytes
    return big.join(F.broadcast(small) if held <= BROADCAST_BYTES else small, on, how)


def _words_of_forms(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(mini, doc, key, tag, start, n, words) of wanted segments; words are 64-bit hashes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                yield some(batch.slice(at, SLICE))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        for tag, doc, text, list_ in zip(*(c.to_pylist() for c in batch.columns)):
            key = row_key(doc, text)
            hashes = word_hashes(words_of(text)).astype("<u8")
            for s in list_:
                own = hashes[s["start"] : s["start"] + s["n"] + WINDOW - 1]
                if s["hot"]:
                    for i, h in enumerate(window_hashes(own, WINDOW).astype(np.int64)):
                        out.append((int(h), doc, key, tag, s["start"] + i, 1, None))
                else:
                    out.append((s["mini"], doc, key, tag, s["start"], s["n"], own.tobytes()))
        columns = list(zip(*out)) or [[]] * 7
        kinds = (*[pa.int64()] * 4, pa.int32(), pa.int32(), pa.binary())
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)],
            ["mini", "doc", "key", "tag", "start", "n", "words"],
        )

    lists = settle(
        wanted.groupBy("tag").agg(F.collect_list(F.struct("mini", "start", "n", "hot")).alias("s")),
        "wanted",
    )
    held = (wanted.count() + 2 * lists.count()) * 24
    tagged = rows.withColumn("tag", _tag("doc", "text"))
    joined = tagged.join(F.broadcast(lists) if held <= BROADCAST_BYTES else lists, "tag")
    return joined.select("tag", "doc", "text", "s").mapInArrow(
        giving_back(cut),
        "mini bigint, doc bigint, key bigint, tag bigint, start int, n int, words binary",
    )


def _search_shards(forms: DataFrame, shards: int) -> DataFrame:
    """(tag, start, n): runs of windows whose words start earlier in their shard."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        # Corpus order: places in the indexed text compare like (id, row, start).
        table = table.sort_by([("doc", "ascending"), ("key", "ascending"), ("start", "ascending")])
        nulls = np.array(table.column("doc").is_null())
        table = table.take(pa.array(np.argsort(~nulls, kind="stable")))
        words = [np.frombuffer(w, "<u8") for w in table.column("words").to_pylist()]
        sizes = np.array([len(w) for w in words])
        begin = np.cumsum(sizes + 1) - sizes - 1
        text = np.zeros(int(sizes.sum()) + len(words), dtype=np.int64)
        inside = np.ones(len(text), dtype=bool)
        inside[begin + sizes] = False
        text[inside] = np.unique(np.concatenate(words), return_inverse=True)[1] + 1
        index = FMIndex(text)
        windows = sizes - WINDOW + 1
        owner = np.repeat(np.arange(len(words)), windows)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[owner] + offset
        alive, low, high = matching_windows(index, text, at + WINDOW, WINDOW)
        later = alive[earliest(index, low, high) < at[alive]]
        if not len(later):
            return
        later.sort()
        run = np.flatnonzero(
            np.concatenate(([True], (np.diff(later) != 1) | (np.diff(owner[later]) != 0)))
        )
        lengths = np.diff(np.concatenate((run, [len(later)])))
        first = later[run]
        own = pa.array(owner[first])
        yield pa.RecordBatch.from_arrays(
            [
                table.column("tag").take(own).combine_chunks(),
                pa.array(
                    (table.column("start").to_numpy()[owner[first]] + offset[first]).astype(np.int32)
                ),
                pa.array(lengths.astype(np.int32)),
            ],
            ["tag", "start", "n"],
        )

    return forms.repartition(shards, "mini").mapInArrow(
        giving_back(search), "tag bigint, start int, n int"
    )


def _repeated_segments(rows: DataFrame) -> DataFrame:
    """Segments whose minimizer occurs again.

    All segments are written once, since both sides of the join need them, and go afterwards.
    """
    with temporary_tables(rows.sparkSession):
        found = settle(_segments_of(rows), "all-segments")
        again = settle(
            found.groupBy("mini").agg(F.count("*").alias("m")).where("m > 1").select("mini"), "again"
        )
        return settle(_joined(found, again, ["mini"], "inner", 8), "segments", keep=True)


def repeated_windows(rows: DataFrame) -> DataFrame:
    """(tag, start, n) of runs of windows that also start earlier, from (doc, text) rows."""
    spark = rows.sparkSession
    kept = _repeated_segments(rows)
    place = F.struct("doc", "key", "start")
    forms = settle(
        kept.groupBy("mini", "form")
        .agg(F.min(F.struct("doc", "key", "start", "tag")).alias("p"), F.first("n").alias("n"))
        .select("mini", "form", "p.*", "n"),
        "forms",
    )
    several = forms.groupBy("mini").agg(F.count("*").alias("f")).where("f > 1")
    wanted = forms.join(several, "mini").select(
        "mini", "tag", "start", "n", (F.col("f") > MOST_FORMS).alias("hot")
    )
    words = settle(_words_of_forms(rows, settle(wanted, "mixed")), "words")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    in_shards = _search_shards(words.where("words is not null"), shards)

    hot = words.where("words is null")
    firsts = hot.groupBy("mini").agg(F.min(place).alias("p"), F.count("*").alias("m"))
    in_hot = hot.join(firsts.where("m > 1"), "mini").where(place > F.col("p"))

    # All but the earliest of each form.  The place is part of the key, so that a form with
    # very many copies is dealt over all tasks; a null id is a place like any other.
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("mini", "form", "doc", "key", "start")]
    copies = kept.alias("k").join(forms.alias("f"), same, "left_anti")
    out = copies.select("tag", "start", "n").unionByName(in_shards)
    return out.unionByName(in_hot.select("tag", "start", "n"))


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns of ``docs`` and removed: [from, to) word spans covered by repeated windows.

    A window is removed if its words also start earlier: in a document with a smaller id, or
    earlier in the same document.  Null ids come first; rows that share an id are ordered by
    a hash of their text, and equal rows are not repeats of each other.  Documents without
    repeats have an empty array.  A clashing column is replaced.
    """
    docs = docs.drop("removed")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.col(text_col).alias("text"))
    with temporary_tables(docs.sparkSession):
        spans = settle(
            repeated_windows(rows).distinct().groupBy("tag").agg(
                F.array_sort(
                    F.collect_list(
                        F.struct("start", (F.col("start") + F.col("n") + WINDOW - 1).alias("end"))
                    )
                ).alias("removed")
            ),
            "spans",
            keep=True,
        )
    # The spans grow with the documents, so this join is shuffled at every size.
    spans = spans.withColumnsRenamed({"tag": "_tag"})
    tagged = docs.withColumn("_tag", F.xxhash64(F.col(id_col).cast("bigint"), F.col(text_col)))
    joined = tagged.join(spans, "_tag", "left")
    return joined.select(
        *docs.columns,
        F.coalesce("removed", F.array().cast("array<struct<start: int, end: int>>")).alias("removed"),
    )


def _merged(spans: list) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        a, b = s["start"], s["end"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of (doc_id, text)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, digests = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2)):
                words = words_of(text.as_py())
                kept, at, gone = [], 0, 0
                for a, b in _merged(spans.as_py()):
                    kept += words[at:a]
                    at, gone = b, gone + b - a
                kept += words[at:]
                totals.append(len(words))
                removed.append(gone)
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(digests),
                ],
                ["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    found = find_repeats(docs.select("doc_id", "text"))
    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    return found.select(F.col("doc_id").cast("bigint"), "text", "removed").mapInArrow(giving_back(digest), schema)


def without_words(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of the spans and the white space after them."""
    if not spans or text is None:
        return text
    marks = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for a, b in _merged(spans):
        out.append(text[at : marks[a]])
        at = marks[b]
    return "".join(out) + text[at:]


def remove_repeats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with repeated windows cut out; documents left without words are dropped.

    Documents without repeats, those without words included, stay as they are.
    """
    found = find_repeats(docs, text_col=text_col)
    at, spans = found.columns.index(text_col), found.columns.index("removed")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE):
                yield some(batch.slice(k, SLICE))

    def some(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(at)
        marked = np.asarray(pc.list_value_length(batch.column(spans))) > 0
        if not marked.any():
            return batch
        rows = pa.array(np.flatnonzero(marked))
        own = zip(column.take(rows).to_pylist(), batch.column(spans).take(rows).to_pylist())
        texts = [without_words(text, list_) for text, list_ in own]
        left = np.ones(batch.num_rows, dtype=bool)
        left[marked] = [bool(_WORD.search(t)) for t in texts]
        new = pc.replace_with_mask(column, pa.array(marked), pa.array(texts, column.type))
        return batch.set_column(at, batch.schema.field(at), new).filter(pa.array(left))

    # One pass for the texts and for the filter: as a function that both name, it would run
    # twice in each task, in two Python workers.
    return found.mapInArrow(giving_back(cut), found.schema).select(*docs.columns)
