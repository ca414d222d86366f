"""Benchmark decontamination: stream documents through suffix automata of the items."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridsieve.llm.automaton import SuffixAutomaton, benchmark_words
from gridsieve.llm.memory import giving_back

WINDOW = 13
# A document is contaminated if at least one in so many of its words is hit.
COVERAGE = 20
# Words of items in one automaton; more items are dealt to several automata.
AUTOMATON_WORDS = 400_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")

_SPANS = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
SPANS = "array<struct<from: bigint, to: bigint>>"


def build_automata(
    benchmark: DataFrame,
    window: int = WINDOW,
    most_words: int = AUTOMATON_WORDS,
    item_col: str = "item_id",
    text_col: str = "text",
) -> list[SuffixAutomaton]:
    """Automata over all items, each of about ``most_words`` words.

    Items without words are left out.  An item id on several rows stands for one item with
    several texts.  An item without an id is hit like any other; its name is None.  A benchmark is read to the driver part by part.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")
    ).where("t is not null")
    size = items.agg(F.sum(F.octet_length("t") / 2)).first()[0] or 0
    parts = max(1, -(-int(size) // most_words))
    out = []
    for p in range(parts):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == p).toLocalIterator()
        some = [(r["i"], benchmark_words(r["t"])) for r in rows]
        if some:
            some.sort(key=lambda s: (s[0] is not None, s[0] or "", s[1]))
            out.append(SuffixAutomaton(some, window))
    return out


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text_col: str = "text",
    most_words: int = AUTOMATON_WORDS,
) -> DataFrame:
    """Columns of ``docs`` and n_words, spans (of hit words), items (sorted item ids).

    Items without an id count for the spans and are not named.

    The automata are broadcast, each bounded by ``most_words``; documents are not shuffled.
    With several automata one pass over the documents is made for each, and the few
    documents with hits are merged by the digest of their text.  Names that clash with the
    added columns are replaced.
    """
    docs = docs.drop("n_words", "spans", "items")
    spark = docs.sparkSession
    automata = build_automata(benchmark, window, most_words)
    if len(automata) <= 1:
        return _searched(docs, automata[0] if automata else None, text_col)
    key = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = docs.select(F.col(text_col).alias("text"))
    hits = None
    for automaton in automata:
        part = _searched(texts, automaton, "text").where(F.size("spans") > 0)
        part = part.select(F.sha2("text", 256).alias("_key"), "spans", "items")
        hits = part if hits is None else hits.unionByName(part)
    hits = hits.groupBy("_key").agg(
        F.flatten(F.collect_set("spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    plain = _searched(docs, None, text_col).drop("spans", "items")
    found = plain.withColumn("_key", key).join(hits, "_key", "left").drop("_key")
    empty = F.array().cast("array<string>")
    spans = F.coalesce("spans", F.array().cast(SPANS))
    return found.withColumn("spans", _merged(spans)).withColumn(
        "items", F.coalesce("items", empty)
    )


def _merged(spans):
    """Overlapping or touching spans as one, in order."""

    def add(done, s):
        last = F.element_at(done, -1)
        longer = F.struct(last["from"].alias("from"), F.greatest(last["to"], s["to"]).alias("to"))
        joins = F.when(F.size(done) > 0, s["from"] <= last["to"]).otherwise(F.lit(False))
        head = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(joins, F.concat(head, F.array(longer))).otherwise(
            F.concat(done, F.array(s))
        ).cast(SPANS)

    return F.aggregate(F.array_sort(spans), F.array().cast(SPANS), add)


def _searched(docs: DataFrame, automaton: SuffixAutomaton | None, text_col: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(automaton)
    at = docs.columns.index(text_col)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = held.value
        for batch in batches:
            counts, spans, items = [], [], []
            for text in batch.column(at):
                words = benchmark_words(text.as_py())
                counts.append(len(words))
                own, names = automaton.hits(words) if automaton else ((), ())
                spans.append([{"from": a, "to": b} for a, b in own])
                items.append(sorted(name for name in names if name is not None))
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(counts, pa.int64()),
                    pa.array(spans, _SPANS),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=[*batch.schema.names, "n_words", "spans", "items"],
            )

    added = f"n_words bigint, spans {SPANS}, items array<string>"
    schema = StructType(docs.schema.fields + StructType.fromDDL(added).fields)
    return docs.mapInArrow(giving_back(search), schema)


def n_hit():
    """Hit words of a row of ``find_contamination``."""
    return F.aggregate(
        "spans", F.lit(0).cast("bigint"), lambda n, s: n + s["to"] - s["from"]
    )


def contaminated(coverage: int = COVERAGE):
    """Some word is hit, and at least one in ``coverage`` words."""
    return (n_hit() > 0) & (n_hit() * coverage >= F.col("n_words"))


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and are clean; an empty benchmark hits nothing;
    repeated rows are reported each; ids may be null.
    """
    found = find_contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def without_spans(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of the given spans and what stands between them."""
    if not spans:
        return text
    marks = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    out, last = [], 0
    for s in spans:
        out.append(text[last : marks[s["from"]][0]])
        last = marks[s["to"] - 1][1]
    out.append(text[last:])
    return "".join(out)


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    coverage: int = COVERAGE,
    most_span: int | None = None,
    whole_documents: bool = False,
    text_col: str = "text",
) -> DataFrame:
    """``docs`` without contamination, columns unchanged.

    In a document over the coverage limit every hit span is removed, or the document itself
    with ``whole_documents``.  Elsewhere only spans of more than ``most_span`` words are
    removed, if that is given.  Documents within both limits stay as they are.
    """
    found = find_contamination(docs, benchmark, text_col=text_col)
    over = contaminated(coverage)
    if whole_documents:
        found = found.where(~over)
        over = F.lit(False)
    long = F.lit(False)
    if most_span is not None:
        long = F.exists("spans", lambda s: s["to"] - s["from"] > most_span)
    if not whole_documents or most_span is not None:
        cut = F.when(over, F.col("spans")).when(
            long, F.filter("spans", lambda s: s["to"] - s["from"] > (most_span or 0))
        )
        removed = F.udf(without_spans, "string", useArrow=True)
        found = found.withColumn("_cut", cut).withColumn(
            text_col,
            F.when(F.size("_cut") > 0, removed(text_col, "_cut")).otherwise(F.col(text_col)),
        )
    return found.select(*docs.columns)
