"""The corpus pipeline: quality, near duplicates, secrets, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
kept. What it returns is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindrift.llm import bpe, mixing, ngram_join, quality, secret_scan
from spindrift.llm.common import materialize, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    return quality.quality_filter(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.keep_one(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in the texts."""
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents to the sources' target weights, in a shuffled order."""
    return mixing.poisson_mix(docs).select(*[f"`{c}`" for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in place of the texts."""
    return bpe.bpe_encode(docs)


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("secrets", mask_secrets), ("mixing", mix_sources), ("bpe", encode)]

#: SQL can't express the verification of secrets by a trained field, nor BPE; the tests
#: hold run() against brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
