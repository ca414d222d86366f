"""Registered queries of the training-data operators, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridsieve.llm.collocations import COLLOCATIONS_SQL, collocations
from gridsieve.llm.dart_minhash import near_duplicate_classes
from gridsieve.llm.decontamination import contamination_report
from gridsieve.llm.html_graph import extract_pages
from gridsieve.llm.language_id import identify_languages
from gridsieve.llm.license_scan import scan_licenses
from gridsieve.llm.packing import pack_documents
from gridsieve.llm.prefix_trie import TRIE_SQL, conversation_trie
from gridsieve.llm.quality_rules import quality_report, quality_sql
from gridsieve.llm.quality_votes import quality_votes
from gridsieve.llm.substring_index import repeats_report
from gridsieve.llm.token_files import token_file_digest
from gridsieve.llm.url_intervals import URL_SQL, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of about 6 MB, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(6 * 1024 * 1024))


@query("op4_decontamination")
def op4(spark, sf_dir):
    return contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    )


@query("op5_token_files")
def op5(spark, sf_dir):
    return token_file_digest(
        table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"),
        added_tokens=True,
    )


@query("op9_packing")
def op9(spark, sf_dir):
    return pack_documents(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        added_tokens=True,
    )


@query("op1_quality_rules", quality_sql())
def op1(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


@query("op6_quality_votes")
def op6(spark, sf_dir):
    return quality_votes(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_dart_minhash")
def op7(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents"))


@query("op10_substring_index")
def op10(spark, sf_dir):
    return repeats_report(table(spark, sf_dir, "documents"))


@query("op2_html_graph")
def op2(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))


@query("op3_url_intervals", URL_SQL)
def op3(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"))


@query("op8_language_id")
def op8(spark, sf_dir):
    return identify_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


@query("op13_license_scan")
def op13(spark, sf_dir):
    return scan_licenses(table(spark, sf_dir, "documents"))


@query("op11_prefix_trie", TRIE_SQL)
def op11(spark, sf_dir):
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query("op12_collocations", COLLOCATIONS_SQL)
def op12(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))
