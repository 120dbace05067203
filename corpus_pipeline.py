"""The corpus pipeline: language ID, near-dedup, repeated passages, benchmark leaks, tokens.

Each stage takes the documents its predecessor kept; all but the last return the columns of documents. Between stages the
documents are written as Parquet to the shared store and read again, so a lost executor costs a stage's tasks at most; what a
stage stored for itself goes when it has been written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rookery.llm import bpe, decontam, langid, simhash, suffixdedup
from rookery.llm.common import dropped, scratch, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near a centroid of some language, learnt from the documents themselves; the others go."""
    return langid.only_known(docs, langid.learn(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles of Jaccard similarity 0.8 or more the document with the least id."""
    return simhash.near_copies(docs, shingle_words=5, similarity=0.8)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later copies of 200-byte strings, by the order of ids; n_chars follows."""
    return suffixdedup.without_repeats(docs, keep_first_by="doc_id")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any ten-word window of a benchmark item."""
    return decontam.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)"""
    return bpe.encode_documents(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]
#: SQL expresses neither the language model nor the byte-level stages; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            after = stored(stage(spark, docs, sf_dir), name, owned=False)
        dropped(docs)
        docs = after
    return docs
