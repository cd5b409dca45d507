"""File readers and writers with explicit schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph import schemas as S
from claimgraph.session import shared_folder

BAD_RECORD = "_bad_record"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{shared_folder(spark)}/run-{uuid.uuid4().hex}"


def _json(spark: SparkSession, path: str, schema: T.StructType, one_per_line: bool) -> DataFrame:
    """JSON objects or arrays, a file each or one per line; unparsable text lands in ``_bad_record``.

    Files with one object per line split across tasks, so large exports should use them.
    """
    with_bad = T.StructType(schema.fields + [T.StructField(BAD_RECORD, T.StringType())])
    return (spark.read.schema(with_bad).option("multiLine", not one_per_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_RECORD).json(path))


def read_articles(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _json(spark, path, S.RAW_ARTICLE, one_per_line)


def read_chunks(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _json(spark, path, S.CHUNK, one_per_line)


def read_assertions(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _json(spark, path, S.ASSERTION, one_per_line)


def read_relations(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _json(spark, path, S.RELATION, one_per_line)


def read_queries(spark: SparkSession, path: str, one_per_line: bool = False) -> DataFrame:
    return _json(spark, path, S.EVAL_QUERY, one_per_line)


def read_grammar(spark: SparkSession, path: str) -> DataFrame:
    """Files holding one map from assertion id to its classification."""
    entries = T.MapType(T.StringType(), S.GRAMMAR_ENTRY)
    return explode_grammar(spark.read.text(path, wholetext=True), F.from_json("value", entries))


def explode_grammar(files: DataFrame, entries: Column) -> DataFrame:
    return (files.select(F.explode(entries).alias("key", "entry"))
            .select(F.coalesce("entry.assertion_id", "key").alias("assertion_id"),
                    "entry.discourse_role", "entry.validity_claim_type"))


def read_filing_index(spark: SparkSession, path: str) -> DataFrame:
    """Every column is text: leading zeros of identifiers stay."""
    return spark.read.option("header", True).schema(S.FILING_INDEX).csv(path)


def write_filing_index(index: DataFrame, path: str) -> None:
    index.select(*S.FILING_INDEX.fieldNames()).write.mode("overwrite").option("header", True).csv(path)


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """(name) of a flat YAML list; quotes and comments go."""
    item = F.regexp_extract("value", r"^\s*-\s+(.*?)\s*(?:\s#.*)?$", 1)
    return (spark.read.text(path).select(F.regexp_replace(item, "^([\"'])(.*)\\1$", "$2").alias("name"))
            .where("name <> ''"))


def write_gazetteer(names: DataFrame, path: str) -> None:
    names.select(F.concat(F.lit('- "'), "name", F.lit('"'))).write.text(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("chunk_id bigint, document_id bigint, vector array<float>").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("chunk_id", "document_id", "vector").write.mode("overwrite").parquet(path)


def manifest(chunks: DataFrame, corpus: str, part_chunks: int = 10_000) -> DataFrame:
    """Documents with their chunks as an array, ready for ``write.json``.

    A document of any size is written in parts of at most ``part_chunks``
    chunks, so no task ever holds an unbounded array; ``chunk_count`` counts the
    whole document.  A document below the limit is one row with ``part`` 0.
    """
    piece = F.struct("sequence", "chunk_id", F.col("section_title").alias("source"), "cik", "period",
                     F.col("content").alias("text"), F.length("content").alias("char_count"))
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))
    parts = (chunks.withColumn("part", F.floor(F.col("sequence") / part_chunks))
             .groupBy("document_id", "part", "cik", "period")
             .agg(F.array_sort(F.collect_list(piece)).alias("chunks")))
    return (parts.join(counts, "document_id")
            .select(F.col("document_id").alias("doc_id"), F.lit(corpus).alias("corpus"), "part", "chunk_count",
                    "chunks", F.struct("cik", "period", F.lit("10-K").alias("source")).alias("metadata")))


def write_json(rows: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Spark's commit protocol makes the output appear whole or not at all."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).json(path)
