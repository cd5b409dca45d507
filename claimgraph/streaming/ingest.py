"""Resumable ingest of articles and extractor responses.

The checkpoint remembers which files were read; an id that is already stored is
not stored again; rows that cannot be used go to a side table for a retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimgraph import schemas as S
from claimgraph.functions.ranking import top_per_key
from claimgraph.operators.chunking import chunk_articles
from claimgraph.sources.files import BAD_RECORD
from claimgraph.sources.responses import failed_responses, parse_assertions, usable_responses
from claimgraph.streaming import tables

DOCUMENTS = S.struct(document_id=T.StringType(), title=T.StringType(), url=T.StringType(), content=T.StringType(),
                     domain=T.StringType())
CHUNKS = S.struct(chunk_id=T.StringType(), document_id=T.StringType(), sequence=T.IntegerType(),
                  section_title=T.StringType(), content=T.StringType(), token_estimate=T.IntegerType())
REJECTED = S.struct(title=T.StringType(), url=T.StringType(), **{BAD_RECORD: T.StringType()})
RESPONSES = S.struct(chunk_id=T.StringType(), document_id=T.StringType(), doc_title=T.StringType(), raw=T.StringType())


def article_stream(spark: SparkSession, source: str, one_per_line: bool = False, files_per_batch: int = 1000) -> DataFrame:
    schema = T.StructType(S.RAW_ARTICLE.fields + [T.StructField(BAD_RECORD, T.StringType())])
    return (spark.readStream.schema(schema).option("multiLine", not one_per_line).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", BAD_RECORD).option("maxFilesPerTrigger", files_per_batch).json(source))


def ingest_articles(articles: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Start the ingest; it stops once the files present at the start are read."""
    spark = articles.sparkSession
    paths = {name: f"{target}/{name}" for name in ("documents", "chunks", "rejected")}
    for name, schema in [("documents", DOCUMENTS), ("chunks", CHUNKS), ("rejected", REJECTED)]:
        tables.prepare(spark, paths[name], schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        usable = F.col("title").isNotNull() & F.col("content").isNotNull() & F.col(BAD_RECORD).isNull()
        tables.write_batch(batch.where(~usable).select(*REJECTED.fieldNames()), paths["rejected"], batch_id)
        documents = batch.where(usable).withColumn("document_id", F.replace("title", F.lit(" "), F.lit("_")))
        first = top_per_key(documents, ["document_id"], [F.col("fetched_at"), F.col("url"), F.col("content")], 1)
        known = tables.read_before(spark, paths["documents"], DOCUMENTS, batch_id).select("document_id")
        fresh = first.join(known, "document_id", "left_anti").select(*DOCUMENTS.fieldNames())
        tables.write_batch(fresh, paths["documents"], batch_id)
        stored = tables.read_batch(spark, paths["documents"], DOCUMENTS, batch_id)
        tables.write_batch(chunk_articles(stored).select(*CHUNKS.fieldNames()), paths["chunks"], batch_id)

    return (articles.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def response_stream(spark: SparkSession, source: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).json(source)


def ingest_responses(responses: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Typed assertions from responses; text that does not parse waits in ``failed``.

    Only answers that parse compete for their chunk, so a broken answer never hides a
    good one.  ``open_failures`` has the failures that no later answer has resolved.
    """
    spark = responses.sparkSession
    shape = parse_assertions(spark.createDataFrame([], RESPONSES)).schema
    tables.prepare(spark, f"{target}/assertions", shape)
    tables.prepare(spark, f"{target}/failed", RESPONSES)

    def store(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(failed_responses(batch), f"{target}/failed", batch_id)
        # A chunk answered twice keeps its first answer that parses.
        known = tables.read_before(spark, f"{target}/assertions", shape, batch_id).select("chunk_id").distinct()
        good = usable_responses(batch).join(known, "chunk_id", "left_anti")
        first = top_per_key(good, ["chunk_id"], [F.col("raw")], 1)
        tables.write_batch(parse_assertions(first), f"{target}/assertions", batch_id)

    return (responses.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def open_failures(spark: SparkSession, target: str) -> DataFrame:
    """Failed responses of chunks that have no assertions yet."""
    failed = tables.read(spark, f"{target}/failed", RESPONSES).drop("batch")
    return failed.join(spark.read.parquet(f"{target}/assertions").select("chunk_id").distinct(), "chunk_id", "left_anti")
