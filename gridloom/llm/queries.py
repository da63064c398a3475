"""The corpus queries op1 to op13 and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gridloom.llm.bpe import encode_documents
from gridloom.llm.common import table
from gridloom.llm.conversations import ORACLE_SQL as REPAIR_SQL
from gridloom.llm.conversations import repair_conversations
from gridloom.llm.fingerprints import fingerprint_documents
from gridloom.llm.html import extract_pages
from gridloom.llm.jaccard import ORACLE_SQL as LINKS_SQL
from gridloom.llm.jaccard import link_documents
from gridloom.llm.language import identify_documents
from gridloom.llm.lines import ORACLE_SQL as LINES_SQL
from gridloom.llm.lines import dedup_report
from gridloom.llm.middle import ORACLE_SQL as MIDDLE_SQL
from gridloom.llm.middle import report_middle
from gridloom.llm.neighbours import search_embeddings
from gridloom.llm.packing import pack_documents
from gridloom.llm.secrets import oracle_sql as secrets_sql
from gridloom.llm.secrets import report_secrets
from gridloom.llm.sharding import shard_documents
from gridloom.llm.substrings import ORACLE_SQL as REPEATS_SQL
from gridloom.llm.substrings import report_repeats


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of every document; see ``lines.dedup_lines`` for odd rows."""
    return dedup_report(table(spark, sf_dir, "documents"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, digests and likenesses of every document; see ``fingerprints.fingerprint_documents``."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; see ``jaccard.link_documents``."""
    return link_documents(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document; see ``language.identify_documents``."""
    return identify_documents(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score of every twentieth vector's 20 nearest; see ``neighbours.nearest``."""
    return search_embeddings(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of ids and decoded bytes of every document; see ``bpe.encode_documents``."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document; see ``substrings.report_repeats``."""
    return report_repeats(table(spark, sf_dir, "documents"))


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars of every page; see ``html.extract_pages``."""
    return extract_pages(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence; see ``packing.pack_documents``."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every document; see ``sharding.shard_documents``."""
    return shard_documents(table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document; see ``secrets.find_secrets``."""
    return report_secrets(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and digests of every document; see ``middle.fill_in_middle``."""
    return report_middle(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, counts of faults, cost, audit, repaired_sha256 of every conversation; see ``conversations.repair_conversations``."""
    return repair_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_fingerprints": op2_fingerprints,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_language_id": op4_language_id,
        "op5_neighbours": op5_neighbours,
        "op6_bpe": op6_bpe,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_html": op8_html,
        "op9_packing": op9_packing,
        "op10_sharding": op10_sharding,
        "op11_secrets": op11_secrets,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_conversation_repair": op13_conversation_repair,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": LINES_SQL,
        "op3_jaccard_join": LINKS_SQL,
        "op7_suffix_dedup": REPEATS_SQL,
        "op11_secrets": secrets_sql(),
        "op12_fill_in_middle": MIDDLE_SQL,
        "op13_conversation_repair": REPAIR_SQL,
    }
