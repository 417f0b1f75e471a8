"""One query per corpus operator, applied to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontaminate, html, langid, phrases, pieces, rules, simhash, substrings, tokens, trie_lm, warc, whitening
from .base import query, table
from .common import scratch


@query("op2_simhash")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query("op5_quality_rules", rules.sql())
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return rules.quality(table(spark, folder, "documents"))


@query("op4_decontaminate", decontaminate.SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


@query("op10_token_orc")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "tokens")
    tokens.write_tokens(table(spark, folder, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return tokens.token_table(spark, path)


@query("op7_warc_zip")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_records(warc.index_table(spark, path)).drop("url")


@query("op6_quality_classifier")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return classifier.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op9_language_id")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


@query("op3_html_text")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return html.main_texts(table(spark, folder, "pages"))


@query("op1_sentencepiece")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trips(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op8_substring_dedup")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.repeated_passages(table(spark, folder, "documents")).drop("digest")


@query("op12_phrases", phrases.SQL)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.collocations(table(spark, folder, "documents"))


@query("op13_whitening")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whitened(table(spark, folder, "embeddings"))


@query("op11_trie_lm")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return trie_lm.text_scores(table(spark, folder, "documents"))
