"""Corpus preparation end to end: each stage works on all that its predecessor kept, and its decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stellarframe.llm import common, decontaminate, language_id, packing, pii, queries, simhash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go: null, empty, or without any letter."""
    return language_id.keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.keep_clean(docs, queries.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates; n_chars follows the new text. No document goes."""
    out = pii.surrogates(docs, queries.pii_key(spark))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048: where each piece of each document lies."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near copies", near_copies),
    ("benchmarks", benchmarks),
    ("personal data", personal_data),
    ("sequences", sequences),
]

#: Classifier, fingerprints, edit distance and tokenizer have no SQL form; tests/llm/test_pipeline.py holds the stages and run() to plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage for sf_dir's documents; what a stage returns is written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = common.materialise(out, name.replace(" ", "-")) if k + 1 < len(STAGES) else out
    return docs
