"""A training-data pipeline over the documents table.

Language id (rejected documents go), quality (rejected documents go), near-duplicates
(one document of each group stays), mixing to target weights, and piece encoding. Every
stage takes what the one before kept, written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ripplegraph.llm import language_id, mixing, near_dedup, pieces, quality
from ripplegraph.llm.common import stored, table

#: Words of a shingle.
SHINGLE_WORDS = 5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; those without a letter or with a near draw go."""
    return language_id.accepted(docs, language_id.fit(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as labels of quality 1 do."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies."""
    return near_dedup.one_of_each(docs, words=SHINGLE_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn towards the target shares of source, language and topic."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, lossless, ids of each document."""
    import public_tokenizers

    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language_id", languages), ("quality", good_quality), ("near_duplicates", near_duplicates), ("mixing", mix), ("encoding", encode)]

#: No stage's decisions can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
