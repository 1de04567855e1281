"""From raw documents to packed training sequences.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Defined results: null and empty texts, and texts without a letter, have no language and go in the first stage; rows that
repeat a document (same doc_id, same text up to white space) stay once; of equal texts the longest original, then the
smallest doc_id stays, a null doc_id counting as the largest.  Documents with a null doc_id are told apart by their
text, are linked with nothing as near duplicates, and are packed with a null doc_id.  Rows that share a doc_id are one document to
the near-duplicate stage: all of them stay or go.  Very long texts are read whole by every stage.  Extra columns, whatever
their names, pass through all stages but the last.  n_chars counts the characters that the substring stage leaves; a
text of which nothing is left stays as an empty document (its closing id).  An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, language_id, minhash, packing, substring_dedup
from tessera.llm.common import fewer, load, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, or no letter in it) go."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer(exact_dedup.keep_one(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their shingles of five words stays."""
    return fewer(minhash.keep_representatives(docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fewer(substring_dedup.strip(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("packing", pack_sequences),
]

#: Language models, minima and packing are no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
