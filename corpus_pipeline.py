"""A corpus pipeline over ``documents``: each stage works on all that the one before kept, from Parquet to Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagemill.llm import decontaminate, exact_dedup, language_id, pieces, queries, simhash
from triagemill.llm.common import table
from triagemill.plans.staging import stage


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID (operator 3), learned from all folds but 0. Texts without a language go."""
    return language_id.keep_known(docs, language_id.train(docs, language_id.fold(language_id.FOLDS) != 0))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup (operator 6): of equal texts the row with the smallest id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def distinct_content(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup (operator 10): one document of each component stays."""
    return simhash.drop_near_duplicates(docs)


def clean_of_tests(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination (operator 9): documents that hold a window of an item go, short hits are cut out."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding and decoding (operator 4): ids, and the text read back from them."""
    return pieces.encode_documents(docs, queries.PIECE_MODEL)


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", distinct_texts),
    ("simhash_near_dedup", distinct_content),
    ("decontamination", clean_of_tests),
    ("sentencepiece", encoded),
]

#: Training, fingerprints and the automaton are beyond SQL; tests compare with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
