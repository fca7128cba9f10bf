"""The corpus pipeline: language, near copies, mix, packing; each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm.common import discard, stored, table
from clausemill.llm.langid import known_language
from clausemill.llm.mixing import mixed_rows
from clausemill.llm.packing import pack
from clausemill.llm.simhash import one_of_each


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject."""
    return known_language(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return pack(docs)


STAGES = [
    ("language", keep_known_languages),
    ("near_copies", drop_near_copies),
    ("mix", mix_sources),
    ("packing", pack_sequences),
]

#: Trained, hashed and packed results have no SQL twin; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
