"""Corpus cleaning: language, exact copies, near copies, benchmark leaks, then token ids.

In every stage null texts are empty, texts may be of any length, repeated rows and ids are rows of their own, further columns go
through whatever their names, and an empty table gives an empty result. What a stage does beyond that is said there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.checks.registry import query
from tickloom.llm import decontaminate, exact, language, pieces, simhash
from tickloom.llm.shared import stored, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; those without a letter go, null and empty texts with them.

    The languages are learned from the labelled rows among ``docs``; where no row has a label, every text with a letter stays.
    """
    return language.with_language(docs, language.fit(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, equal up to runs of white space: the one with the smallest id, null ids last; of equal ids any one."""
    return exact.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose fingerprints link at two bits or fewer; texts without words are one group."""
    return simhash.one_of_each(docs, shingle_words=3, max_bits=2)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item stands; null and wordless items match nothing."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text they decode to."""
    found = pieces.decode(pieces.encode(docs))
    return found.select(F.col("id").alias("doc_id"), "ids", "decoded")


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("decontaminate", benchmark_leaks),
    ("sentencepiece", token_ids),
]

#: SQL expresses no model, fingerprint or tokenizer.
ORACLE_SQL = None


@query("pipeline", ORACLE_SQL)
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
