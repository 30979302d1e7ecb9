"""Cleaning a corpus: language, quality, near copies, shared passages, packing."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from daygrid.llm import jaccard, language, packing, quality, substrings
from daygrid.llm.common import folder

#: The trained stages have no SQL; tests hold the pipeline against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose words with a letter are labelled with a certainty of at least one half, in one language or several, as they are."""
    return language.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the rules of repetition, as they are."""
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingle sets with a similarity of 0.8 or more connect: that of the smallest id."""
    return jaccard.one_of_each(docs, words=5, percent=80)


def shared_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without windows of 20 words that also begin earlier; texts of which nothing is left go."""
    return substrings.remove_repeats(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096: the place of every piece of every text that is left."""
    return packing.best_fit(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality_rules", quality_rules), ("ngram_jaccard_join", near_copies), ("substring_dedup", shared_passages), ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each over what the one before has written."""
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}-{name}")
        docs = spark.read.parquet(f"{path}/{k}-{name}")
    return docs
