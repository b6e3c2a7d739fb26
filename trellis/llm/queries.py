"""Registered queries of the corpus operators: one per operator, over its whole
table, with production parameters.  ``ORACLE_SQL`` has DuckDB text where SQL
can express the result; the others are tested against brute force."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from trellis.sources.tables import table

from .bpe import encode_documents
from .conversation_repair import repair_damaged
from .embedding_dedup import near_duplicate_vectors
from .exact_dedup import duplicate_groups
from .mixing import mix_documents
from .oracle_mixing import SQL as MIXING_SQL
from .packing import pack_documents
from .quality import score_quality
from .simhash_dedup import near_duplicate_components
from .suffix_dedup import remove_repeats
from .token_counts import cleaning_edits, count_with_edits
from .toxicity import score_toxicity
from .url_filter import RULES, SOFT, STRICT, judge_urls
from .vector_codes import compress_vectors

RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PACK_FILE = "byte_bpe_50k.json"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document before and after a cleaning pass."""
    docs = table(spark, sf_dir, "documents").withColumn("edits", cleaning_edits())
    return count_with_edits(docs, public_tokenizers.path(RANK_FILE))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the rules and the vocabulary."""
    return judge_urls(table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix_documents(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts and the row of each that stays."""
    return duplicate_groups(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return near_duplicate_components(table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that repeat 100 bytes met earlier."""
    return remove_repeats(table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at cosine 0.93."""
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, digested, and their decoding."""
    return encode_documents(table(spark, sf_dir, "documents"),
                            public_tokenizers.path(RANK_FILE), with_ids=False)


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces packed into sequences of 1024 ids."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(PACK_FILE))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's code under whole-number codebooks of 256 entries."""
    return compress_vectors(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation damaged by its turns' hashes, repaired and digested."""
    return repair_damaged(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_url_filter": op2_url_filter,
    "op3_quality": op3_quality,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op10_bpe": op10_bpe,
    "op11_packing": op11_packing,
    "op12_vector_codes": op12_vector_codes,
    "op13_conversation_repair": op13_conversation_repair,
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def _distinct_terms(terms) -> str:
    """DuckDB count of the terms that stand between boundaries in ``low``."""
    return " + ".join(f"regexp_matches(low, '(^|[^a-z0-9]){t}($|[^a-z0-9])')::INT" for t in terms)

_ASCII_LOWER = ("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
                "'abcdefghijklmnopqrstuvwxyz')")

ORACLE_SQL = {
    "op5_mixing": MIXING_SQL,
    "op2_url_filter": f"""
        WITH parts AS (
          SELECT page_id, translate(coalesce(url, ''), {_AZ}) AS low,
                 coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), '') AS raw_host,
                 coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
          FROM pages),
        p AS (SELECT page_id, low, translate(raw_host, {_AZ}) AS host, path FROM parts),
        rules(r_host, r_path, r_verdict) AS (VALUES {_RULE_ROWS}),
        fit AS (
          SELECT page_id, arg_max(r_host || r_path, length(r_host || r_path)) AS rule,
                 arg_max(r_verdict, length(r_host || r_path)) AS r_verdict
          FROM (SELECT DISTINCT page_id, host, path FROM p) p JOIN rules
            ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
          GROUP BY page_id, host, path)
        SELECT p.page_id, host, path, rule,
               coalesce(r_verdict, CASE WHEN n_strict > 0 OR n_soft >= 2 THEN 'block'
                                   ELSE 'allow' END) AS verdict, n_strict, n_soft
        FROM (SELECT *, ({_distinct_terms(STRICT)}) AS n_strict,
                     ({_distinct_terms(SOFT)}) AS n_soft FROM p) p
        LEFT JOIN fit USING (page_id)""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_ASCII_LOWER}) AS text_sha256 FROM documents)
        SELECT doc_id,
               max(doc_id) OVER g AS keep_id,
               count(*) OVER g AS group_size,
               row_number() OVER (PARTITION BY text_sha256
                                  ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
               text_sha256
        FROM d WINDOW g AS (PARTITION BY text_sha256)""",
}
