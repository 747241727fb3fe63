"""A training-corpus pipeline in five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's ``docs``.  All but the last return the columns
of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import bpe, mixture, quality, repeats, simhash
from inkprint.llm.common import materialise


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is probable enough stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.select(docs, quality.train(docs, quality.graded(labels), 3))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes and more that stand in several places go; texts shrink, rows stay."""
    return repeats.cut_repeats(docs, length=200, size="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents whose tokens meet the target weights stays."""
    return mixture.sample(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the bytes they decode to; the workers held other stages' memories before."""
    return bpe.encode_column(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True, cache=150_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("mixing", mixing),
    ("encoding", encoding),
]

#: The classifier, the fingerprints and the merges have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
