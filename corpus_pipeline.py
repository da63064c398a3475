"""Corpus preparation in five stages, from raw documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir) that returns the rows it
keeps; ``run`` writes every stage as Parquet in the shared checkpoint folder and
reads it back for the next one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import shared_folder, table
from gridloom.llm.jaccard import keep_one_of_each
from gridloom.llm.language import fit, keep_identified
from gridloom.llm.lines import dedup_lines
from gridloom.llm.packing import pack_documents
from gridloom.llm.substrings import remove_repeats

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with ``n_chars`` of the text as it is now, without documents that lost all of it."""
    left = docs.where(F.char_length("text") > 0)
    return left.withColumn("n_chars", F.char_length("text").cast("long")).select(*[F.col(f"`{c}`") for c in columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language; without a letter, or a language likelier than all others together, they go."""
    return keep_identified(docs, fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near-duplicate lines go, but for the earliest; documents left without text go."""
    return _counted(dedup_lines(docs), docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one of the smallest doc_id stays."""
    return keep_one_of_each(docs)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that also start earlier go; documents left without text go."""
    return _counted(remove_repeats(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of at most 2048 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL cannot express the trained model, tokenization and packing; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the rows of the last one."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
