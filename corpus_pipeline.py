"""The corpus pipeline: quality rules, line dedup, near-duplicate dedup, mixing, and tokenisation, a written table between stages.

Every stage takes the columns of documents and any others, and all but the last return the same columns. Null and empty texts are
rejected by the quality rules; in the later stages they stay (line dedup), are linked with nothing (near dedup), have no words and so no copy in the
mix (mixing) and encode as empty texts. Null ids, languages and sources are values like others; rows that repeat an id are
judged each by its own text. Empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import line_dedup, mixing, near_dedup, quality_rules, sentencepiece_codec
from millrace.llm.common import stored


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs)


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that recur across documents go from the texts; n_chars is that of the text left."""
    return line_dedup.cleaned(docs, length_col="n_chars", counts=False)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of the smallest id stays; rows that repeat its id and text stay with it."""
    return near_dedup.keep_first(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as often as its source's target asks for."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every whole text, with begin and end ids; a row for each copy that the mix has."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", good), ("line_dedup", without_boilerplate), ("near_dedup", one_of_each), ("mixing", mix), ("sentencepiece", tokens)]

#: The last stage's merges are no SQL; the stages are tested against plain Python instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents, each to the written result of the one before."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        df = stage(spark, df, sf_dir)
        if k < len(STAGES) - 1:
            df = stored(df, f"stage-{name}")
    return df
