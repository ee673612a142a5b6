"""The registered queries of the corpus operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import line_dedup, mixing, near_dedup, neighbours, oracles, quality_model, quality_rules, sentencepiece_codec, sharding, substring_dedup, token_store

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.round_trip(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_model.scored(docs, quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.components(_documents(spark, sf_dir))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_documents(spark, sf_dir))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.by_bytes(_documents(spark, sf_dir))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.token_digest(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(_documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated(_documents(spark, sf_dir))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sentencepiece, op2_mixing, op3_quality_classifier, op4_near_dedup, op5_line_dedup, op6_sharding, op7_neighbours, op8_token_output, op9_quality_rules, op10_substring_dedup)}

SQL: dict[str, str] = oracles.SQL
