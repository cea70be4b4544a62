"""From raw documents to packed training sequences.

STAGES are applied in order; each stage's result is written as Parquet and read
again as the next one's documents. All stages but the last return the columns
of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamloom.llm import blocknames, jaccard, mixing, packing, quality
from streamloom.llm.common import materialise, table, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. Trusted are the documents labelled good."""
    return quality.keep_good(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return blocknames.drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the row with the smallest doc_id stays."""
    return jaccard.keep_representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source gets an equal share of the mixture; a document occurs as often as it was drawn."""
    return mixing.mix_sources(docs).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences; a repeated document is packed each time."""
    return packing.pack(docs)


STAGES = [("quality rules", quality_rules), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mix), ("best-fit packing", pack)]

#: hashed log-likelihood ratios, byte-level BPE and a genetic algorithm are not SQL; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage wrote for itself is deleted as soon as its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        with temporary(spark):
            docs = materialise(stage(spark, docs, sf_dir), keep=True)
    return docs
