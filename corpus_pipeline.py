"""A training corpus from documents: quality rules, exact and near deduplication, redaction of secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents. `run` applies them in order.

Defined results, whatever the columns beside doc_id and text hold or are called: null and empty texts fail the quality
rules. For the stages behind, should they get any: a null text is an empty one, equal to other empty ones for exact
deduplication (the smallest id stays), linked with nothing for near deduplication, without secrets, and one end token when
packed. Very long texts are processed whole. Rows repeated under one id come down to one in exact deduplication; the other
stages treat each for itself. A null id is the last of its group in exact deduplication and stays in near deduplication.
An empty table gives an empty table at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from inkveil.llm.common import Scratch, table
from inkveil.llm.exact_dedup import keep_first
from inkveil.llm.near_dedup import keep_representatives
from inkveil.llm.packing import pack
from inkveil.llm.quality import keep_good
from inkveil.llm.secret_scan import redact


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the threshold table stay."""
    return keep_good(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return keep_first(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity of 0.8 or more) one document stays."""
    return keep_representatives(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are masked."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens, packed into sequences."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Packing by column generation is not SQL; the tests hold each stage against a plain computation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs)
    return docs
