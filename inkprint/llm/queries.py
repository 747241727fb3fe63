"""Registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkprint.llm import bpe, fertility, language, lm, mixture, quality, repeats, sharding, simhash, topk


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _fold(modulus: int) -> Column:
    """The held-out fold: crc32 of doc_id as text, 2 modulo ``modulus``; without doc_id a row isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % modulus == 2, F.lit(False))


def op1_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), _fold(7))


def op2_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(_table(spark, sf_dir, "documents"), shards=40)


def op4_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabularies = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return fertility.judge(_table(spark, sf_dir, "documents"), *vocabularies, public_tokenizers.PATTERN)


def op5_bpe_backtrack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_centroid_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"), _fold(4))


def op7_rake_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(_table(spark, sf_dir, "documents"))


def op8_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.strip_repeats(_table(spark, sf_dir, "documents"), length=200)


def op9_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, radius=3)


def op10_nra_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"), k=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: f for name, f in list(globals().items()) if name.startswith("op") and name[2].isdigit()
}
