"""A corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

In every stage: an empty table gives an empty one, other columns pass through under any name (up to the last stage, which
returns what the mix takes), repeated rows are judged alike, and whole texts are read, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import decontaminate, language_id, ngram_join, secret_scan, source_mix
from strandloom.llm.common import materialised, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the corpus's languages.

    Texts that are null or have no letters are in none and go; a corpus without labels has no language and keeps nothing.
    """
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest id, null ids last.

    Null and blank texts are no duplicates and stay; of rows that repeat id and text one stays.
    """
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages.

    Null and blank texts have none; a document that holds one goes with all rows of its id.
    """
    return decontaminate.drop_leaky(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked and n_chars counted anew; null texts stay null."""
    return secret_scan.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes; none of a null or blank text. A null source is a source.

    Ties of the order within a source fall by id and size.
    """
    return source_mix.taken(source_mix.mix(docs))


STAGES = [
    ("language_id", identify_language),
    ("ngram_join", drop_near_duplicates),
    ("decontaminate", drop_leaks),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
]

#: Trained profiles, automata and component search have no SQL form; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
