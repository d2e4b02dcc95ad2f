"""Documents to packed sequences: quality rules, exact dedup, near-dedup, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host does.  Null or empty texts go; a null host is a host of its
    own; repeated rows, ties and other columns pass as they are; an empty table stays empty."""
    from sparrel.llm.quality import keep_good

    return keep_good(docs)


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id, of rows alike in both any one.  A null text is an empty one; a
    null doc_id stays only where a text has no other; very long texts count whole."""
    from sparrel.llm.exact_dedup import keep_first

    return keep_first(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest doc_id.  Texts without words and rows
    without doc_id stay; texts of one doc_id are told apart; very long texts count whole."""
    from sparrel.llm.near_dedup import keep_representatives

    return keep_representatives(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document, in sequences of 1024 tokens.  A null text is an empty one, of which the end id
    is packed; null and repeated doc_ids are packed like any other; very long texts fill many sequences."""
    from sparrel.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte", 0).withColumn("ids_crc32", F.crc32("ids"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("packing", packing_stage),
]

#: Near-dedup and packing by tokens are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again by the next.  An empty table gives
    an empty result."""
    from sparrel.llm.common import materialise, table

    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
