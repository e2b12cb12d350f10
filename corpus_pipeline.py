"""From raw documents to token ids: language, near-duplicates, repeated passages, benchmark passages, encoding.

Each stage takes what the one before kept, as Parquet, and returns it with the columns of documents; the last returns ids.
A document without a language (null, empty, or without a letter) goes; of near-duplicates (five-word shingles with a Jaccard
similarity of 0.8 or more, and chains of such; candidates by SimHash and by MinHash bands) the one with the least doc_id stays; a
repeated passage stays in the document with the least doc_id, and a document of which nothing is left goes; a document that holds a
benchmark item goes. Every stage judges rows, not ids: a null or repeated doc_id takes no other row with it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattisphere.llm import bpe, chunkdedup, decontamination, language, neardup
from lattisphere.llm.queries import table, vocabulary
from lattisphere.llm.shared import BLOCK_BYTES, discard, staged


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.keep_identified(docs)


def near_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def passages_deduped(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chunkdedup.keep_deduped(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), BLOCK_BYTES, extra=("ids",))


STAGES = [
    ("language_id", identified),
    ("simhash_near_dedup", near_deduped),
    ("substring_dedup", passages_deduped),
    ("benchmark_decontamination", decontaminated),
    ("bpe_encoding", encoded),
]

#: SQL cannot express the classifier, the rolling hash or the encoding; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents table, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs, path = staged(stage(spark, docs, sf_dir), name)
        if before:
            discard(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
