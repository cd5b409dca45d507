"""Registered queries of this package, with production parameters over whole tables, and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import (byte_bpe, chat, collocations, decontaminate, language, lattice, licenses, quality, sharding, simhash,
                            token_files, warc, whitening)
from claimgraph.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), byte_bpe.ByteBpe.from_file(path, public_tokenizers.PATTERN))


def op2_chat_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.perspectives(table(spark, sf_dir, "conversations"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_files.round_trip(table(spark, sf_dir, "documents"), path, 2, public_tokenizers.PATTERN, added_tokens=True)


def op6_distribution_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op7_lattice_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = lattice.Vocabulary.from_file(public_tokenizers.path("piece_bpe_32k.model"))
    return lattice.likelihood(table(spark, sf_dir, "documents"), vocabulary, language.is_held_out(7, 2))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"))


SHARDS = 8


def op13_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.layout(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_byte_bpe, op2_chat_perspectives, op3_decontaminate, op4_license_sentences, op5_token_files, op6_distribution_quality,
    op7_lattice_likelihood, op8_language_id, op9_warc_salvage, op10_simhash_groups, op11_collocations,
    op12_whitening, op13_rendezvous_shards)}
# The other operators have no SQL form; tests hold them against brute force or exact round trips.
ORACLES: dict[str, str] = {
    "op2_chat_perspectives": chat.PERSPECTIVES_SQL, "op3_decontaminate": decontaminate.REPORT_SQL,
    "op4_license_sentences": licenses.report_sql(), "op9_warc_salvage": warc.ROUND_TRIP_SQL,
    "op11_collocations": collocations.collocations_sql(), "op13_rendezvous_shards": sharding.layout_sql(SHARDS),
}
