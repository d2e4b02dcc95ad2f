"""The queries of the ten operators, as the driver registers them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import token_file

    docs = table(spark, sf_dir, "documents")
    return token_file(docs, public_tokenizers.path("word_bpe_49k.json"), "word", 2).select("doc_id", "start", "n_tokens", "ids_crc32")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_report

    return quality_report(table(spark, sf_dir, "documents")).drop("host_rate")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import encode_report

    return encode_report(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents before and after an edit in the middle of each."""
    from .token_counts import apply_edits, count_states, middle_edits

    path = public_tokenizers.path("byte_bpe_50k.json")
    states = count_states(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    out = apply_edits(middle_edits(states), path, public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens_before", "n_tokens", "n_encoded")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    return shard(table(spark, sf_dir, "documents"), 16)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "byte", 0)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_token_file, op2_quality_rules, op3_license_scan, op4_exact_dedup, op5_sentencepiece, op6_token_counts,
        op7_sharding, op8_packing, op9_minhash_near_dedup, op10_html_extraction, pipeline,
    )}


def oracle_sql() -> dict:
    from . import near_dedup, quality, sharding

    return {
        "op2_quality_rules": quality.REPORT_SQL, "op4_exact_dedup": OP4_SQL, "op7_sharding": sharding.SHARD_SQL, "op9_minhash_near_dedup": near_dedup.REPORT_SQL,
    }


OP4_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (text_sha256)
"""
