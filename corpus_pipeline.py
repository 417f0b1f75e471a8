"""From raw documents to token ids: quality, near duplicates, repeated passages, benchmark leaks, encoding.

Each stage works on all that its predecessor kept and is written before the next one reads it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tabstudy.llm import classifier, decontaminate, pieces, simhash, substrings
from tabstudy.llm.base import short_batches, table
from tabstudy.llm.common import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rates good."""
    short_batches(spark)
    return classifier.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the least id."""
    short_batches(spark)
    return simhash.one_per_group(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that one with a lesser id holds."""
    short_batches(spark)
    return substrings.remove_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated; smaller hits are cut from them."""
    short_batches(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, ids, scores, text): ids of the best segmentation, scores of the best ones, and the text decoded from the ids."""
    short_batches(spark)
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), paths=False, decoded=True)


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("substring_dedup", repeated_passages), ("decontamination", benchmark_leaks), ("sentencepiece", token_ids)]

ORACLE_SQL = None  # a trained model and verified near passages are beyond SQL; tests compare each stage with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
