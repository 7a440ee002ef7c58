"""A pipeline over `documents`: filter, de-duplicate exactly and nearly, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of docs. Stages are judged on their own input.

Defined cases: null and empty texts have too few words and go in the first stage; a null doc_id or source takes part; of rows equal in text, and of
groups linked by shingles, the row of the smallest doc_id stays (null last, one row of several); rows that share a doc_id but not their text are
documents of their own; very long texts are taken whole; other columns, whatever their names, are carried to the mix; an empty table gives an
empty result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewarden.llm import common, exact_dedup, mixing, ngram_join, quality, sentencepiece


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_documents(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingle overlap."""
    return ngram_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip of each document of the mix."""
    return sentencepiece.encode_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("mixing sources", mix),
    ("SentencePiece encoding", encode),
]

#: SQL cannot express the last stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.stage(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
