"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the
last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridsieve.llm.dart_minhash import keep_one
from gridsieve.llm.decontamination import decontaminate
from gridsieve.llm.packing import pack_documents
from gridsieve.llm.quality_votes import ACCEPTED, score_quality
from gridsieve.llm.queries import bounded_batches, table
from gridsieve.llm.substring_index import remove_repeats
from gridsieve.session import settle, temporary_tables


def accepted_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the voting classifier accepts; its labels come from the labels table."""
    labels = table(spark, sf_dir, "labels")
    scored = score_quality(docs, labels)
    return scored.where(F.col("quality_score") >= ACCEPTED).select(*docs.columns)


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class, the one with the smallest id."""
    bounded_batches(spark)
    return keep_one(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of words that start earlier in the corpus are cut out of the texts."""
    bounded_batches(spark)
    cut = remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go; all others stay as they are."""
    benchmark = table(spark, sf_dir, "benchmark")
    return decontaminate(docs, benchmark, whole_documents=True)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids in sequences of 2048."""
    bounded_batches(spark)
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), added_tokens=True)


STAGES = [
    ("quality_classifier", accepted_quality),
    ("minhash_near_dedup", one_of_each_class),
    ("substring_dedup", without_repeats),
    ("benchmark_decontamination", without_benchmark),
    ("packing", packed),
]

# The classifier, the near-duplicate classes and the token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with temporary_tables(spark):
            docs = settle(stage(spark, docs, sf_dir), name, keep=True)
    return docs
