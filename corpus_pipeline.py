"""The corpus pipeline: documents whose language is known, one of each group of near
copies, without byte strings that repeat, mixed to target weights, as SentencePiece ids.

Every stage takes (spark, docs, sf_dir) and works on all rows of ``docs``; all but the
last return the columns of ``docs``. Empty tables, null ids and texts, repeated rows and
extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from mdforge.llm import hamming_join, langid, mixing, queries, repeats, sp_codec
from mdforge.llm.common import ready, scratch

#: Bytes of a passage that goes where it repeats: some 40 words, so that none of over 50 stays.
#: Anchors are taken from strings of the second number of bytes.
PASSAGE, PASSAGE_GRAM = 240, 40


def tidy(spark: SparkSession) -> None:
    """Let the driver forget the stage before: files of its shuffles go when it does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that was learnt; those without a letter go."""
    return langid.accepted(docs, queries.PIECES)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group linked by five-word shingles."""
    tidy(spark)
    return hamming_join.one_of_each(docs, shingle_words=5, percent=80)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without strings of PASSAGE bytes that also start elsewhere; emptied texts stay."""
    tidy(spark)
    return repeats.without_repeats(docs, PASSAGE, PASSAGE_GRAM)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix uses, in training order."""
    tidy(spark)
    return mixing.mixed_documents(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of every row's ids, and the digest of the text decoded from them."""
    tidy(spark)
    return sp_codec.encode_digests(docs, queries.PIECES)


STAGES = [
    ("language_id", known_language),
    ("near_duplicates", one_of_near_copies),
    ("repeated_bytes", without_repeats),
    ("source_mixing", mixed_sources),
    ("sentencepiece", piece_ids),
]
#: Language models and tokenizers have no SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again;
    what a stage has settled goes when its rows are written."""
    folder = f"{ready(spark)}/mdforge-pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
