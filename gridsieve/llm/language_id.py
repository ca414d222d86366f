"""Language identification of pages by Bayesian fusion of four kinds of evidence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridsieve.llm.html_graph import read_page
from gridsieve.llm.url_intervals import host_of

# Hashed letter trigrams of lower-cased words.
BUCKETS = 1 << 14
# A trigram's log-likelihood ratio counts so far in full text; shares long texts' certainty.
TEXT_WEIGHT = 0.5
# Chances that a declaration or an address names the true language.
MARKUP_TRUST, ADDRESS_TRUST = 0.9, 0.8
# Pseudo-counts that pull a host to its domain and a domain to all pages.
HOST_PULL, DOMAIN_PULL = 5.0, 20.0
_LETTERS = re.compile(r"[^\W\d_]+")


def trigrams(text: str | None) -> np.ndarray:
    """Counts of hashed trigrams of the words of a whole text."""
    raw = (" " + " ".join(_LETTERS.findall((text or "").lower())) + " ").encode("utf-8")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 4:
        return np.zeros(BUCKETS, dtype=np.int64)
    own = (b[:-2] * np.uint32(0x01000193) ^ b[1:-1]) * np.uint32(0x01000193) ^ b[2:]
    return np.bincount((own * np.uint32(0x9E3779B1)) >> np.uint32(18), minlength=BUCKETS)


def text_model(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of trigrams [language, bucket]) from texts with a lang.

    All documents count; a task sends one row for each language and bucket at most, so the
    driver gets BUCKETS rows for each language of the table.
    """
    rows = docs.select("lang", "text").where("lang is not null and text is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                own = total.setdefault(lang.as_py(), np.zeros(BUCKETS, dtype=np.int64))
                own += trigrams(text.as_py())
        for lang, own in total.items():
            some = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(own[some], pa.int64())],
                ["lang", "bucket", "n"],
            )

    counted = (
        rows.mapInArrow(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect()
    )
    languages = sorted({r["lang"] for r in counted})
    counts = np.full((len(languages), BUCKETS), 0.5)
    for r in counted:
        counts[languages.index(r["lang"]), r["bucket"]] += r["n"]
    return languages, np.log(counts / counts.sum(axis=1, keepdims=True))


def text_likelihoods(pages: DataFrame, languages: list[str], logs: np.ndarray) -> DataFrame:
    """(page_id, url, declared, text_logs): one number for each language, of the shown text."""
    held = pages.sparkSession.sparkContext.broadcast(logs)
    lang = re.compile(r"<html[^>]*\slang\s*=\s*[\"']?([A-Za-z]+)", re.I)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, declared = [], []
            for html in batch.column(2):
                html = html.as_py() or ""
                found = lang.search(html)
                declared.append(found.group(1).lower() if found else None)
                own = trigrams(" ".join(t for _, t in read_page(html).runs))
                out.append((TEXT_WEIGHT * (held.value @ own)).tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(declared, pa.string()), pa.array(out, pa.list_(pa.float64()))],
                ["page_id", "url", "declared", "text_logs"],
            )

    rows = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html")
    return rows.mapInArrow(score, "page_id bigint, url string, declared string, text_logs array<double>")


def _vote(named: Column, languages: list[str], trust: float) -> Column:
    """Log-evidence of a named language; none without one of the known languages."""
    other = np.log((1 - trust) / max(1, len(languages) - 1))
    logs = F.array(*[F.when(named == k, float(np.log(trust))).otherwise(float(other)) for k in languages])
    return F.when(named.isin(languages), logs).otherwise(F.array(*[F.lit(0.0)] * len(languages)))


def _best(logs: Column, languages: list[str]) -> Column:
    names = F.array(*map(F.lit, languages))
    return F.get(names, F.array_position(logs, F.array_max(logs)).cast("int") - 1)


def identify_languages(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """page_id, host, declared, addressed, lang and probability of every page.

    1. Texts, the declared markup language and the language in the address (a path part or
       the host's first label) are combined for each page.
    2. The resulting languages are counted by host and domain in grouped aggregations; a
       host's prior is smoothed towards its domain's, and that towards all pages'.
    3. The prior joins the evidence; ties go to the language first in the alphabet.

    Priors come back by a join on the host, whose hot keys adaptive execution splits.  A page
    without a host has the prior of all pages; a null html has no text evidence.  Without
    any labelled text the language is null.
    """
    languages, logs = text_model(docs)
    if not languages:
        return pages.select(
            F.col("page_id").cast("bigint"), host_of(F.col("url")).alias("host"),
            F.lit(None).cast("string").alias("declared"), F.lit(None).cast("string").alias("addressed"),
            F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"),
        )
    known = "|".join(map(re.escape, languages))
    url = F.coalesce("url", F.lit(""))
    path = F.regexp_extract(url, rf"^[a-z]+://[^/]+/(?:[^?#]*/)?({known})(?:[/?#]|$)", 1)
    first = F.regexp_extract(url, rf"^[a-z]+://({known})\.", 1)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    evidence = (
        text_likelihoods(pages, languages, logs)
        .withColumn("host", host_of(F.col("url")))
        .withColumn("addressed", F.coalesce(F.nullif(path, F.lit("")), F.nullif(first, F.lit(""))))
        .withColumn("logs", add(add(F.col("text_logs"), _vote(F.col("declared"), languages, MARKUP_TRUST)), _vote(F.col("addressed"), languages, ADDRESS_TRUST)))
        .select("page_id", "host", "declared", "addressed", "logs")
    )
    first_pick = evidence.select("host", _best(F.col("logs"), languages).alias("lang"))
    counts = [F.sum(F.when(F.col("lang") == k, 1).otherwise(0)).alias(f"n{i}") for i, k in enumerate(languages)]
    every = first_pick.agg(*counts).first()
    total = max(1, sum(x or 0 for x in every))
    prior = [((every[i] or 0) + 1) / (total + len(languages)) for i in range(len(languages))]
    hosts = first_pick.where("host is not null").groupBy("host").agg(*counts)
    hosts = hosts.withColumn("domain", F.substring_index("host", ".", -2))
    n = range(len(languages))
    domains = hosts.groupBy("domain").agg(*[F.sum(f"n{i}").alias(f"d{i}") for i in n])
    size = lambda c: sum((F.col(f"{c}{i}") for i in n), F.lit(0))
    of_domain = [(F.col(f"d{i}") + DOMAIN_PULL * prior[i]) / (size("d") + DOMAIN_PULL) for i in n]
    of_host = [F.log((F.col(f"n{i}") + HOST_PULL * of_domain[i]) / (size("n") + HOST_PULL)) for i in n]
    priors = hosts.join(domains, "domain").select("host", F.array(*of_host).alias("prior"))
    flat = F.array(*[F.lit(float(np.log(p))) for p in prior])
    fused = evidence.join(priors, "host", "left").withColumn("all", add(F.col("logs"), F.coalesce("prior", flat)))
    most = F.array_max("all")
    mass = F.aggregate("all", F.lit(0.0), lambda a, x: a + F.exp(x - most))
    return fused.select("page_id", "host", "declared", "addressed", _best(F.col("all"), languages).alias("lang"), (1 / mass).alias("probability"))
