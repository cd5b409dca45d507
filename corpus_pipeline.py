"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import byte_bpe, decontaminate, language, quality, simhash
from claimgraph.llm.common import table
from claimgraph.sources.files import scratch_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language.keep_identified(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or diverge from their language go."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-copies stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window with a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids): the token ids of what is left."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = byte_bpe.ByteBpe.from_file(path, public_tokenizers.PATTERN)
    return byte_bpe.round_trip(docs, bpe).selectExpr(
        "doc_id", "ids", "cast(length(ids) div 4 as bigint) as n_tokens", "sha2(decoded, 256) as decoded_sha256")


STAGES: list[tuple[str, Stage]] = [("language_id", language_id), ("quality_rules", quality_rules), ("near_dedup", near_dedup),
                                   ("decontamination", decontamination), ("tokens", tokens)]

# Language ID, fingerprints and token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    folder = scratch_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
