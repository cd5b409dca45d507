"""Choosing which filings, documents and queries enter the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions import text as tx
from claimgraph.functions.ranking import top_per_key

# The industry codes, years and limits of the filing corpus.
FINANCIAL_SICS = ["6020", "6021", "6022", "6025", "6026", "6027", "6029", "6035", "6036", "6099",
                  "6141", "6153", "6154", "6159", "6200", "6211", "6311", "6321", "6411"]
FIRST_YEAR, LAST_YEAR = 2018, 2023
CORPUS_CAP = 200
MIN_FILING_CHARS = 2000


def in_scope_filings(index: DataFrame, first_year: int = FIRST_YEAR, last_year: int = LAST_YEAR) -> DataFrame:
    year = F.substring("filing_date", 1, 4).cast("int")
    return index.where(F.col("sic").isin(FINANCIAL_SICS) & year.between(first_year, last_year))


def first_per_period(index: DataFrame) -> DataFrame:
    """One filing per firm and period; ties go to the smallest accession number."""
    return top_per_key(index, ["cik", "period"], [F.col("accession_no")], 1)


def latest_per_firm(index: DataFrame) -> DataFrame:
    return top_per_key(index, ["cik"], [F.desc("filing_date"), F.col("accession_no")], 1)


def newest_firms(index: DataFrame, cap: int = CORPUS_CAP) -> DataFrame:
    return latest_per_firm(index).orderBy(F.desc("filing_date"), "accession_no").limit(cap)


def with_char_count(filings: DataFrame) -> DataFrame:
    size = F.length(F.coalesce("item1", F.lit(""))) + F.length(F.coalesce("item1a", F.lit("")))
    return filings.withColumn("char_count", size)


def extraction_failures(filings: DataFrame) -> DataFrame:
    """Filings in which neither item was found."""
    return filings.where((F.coalesce("item1", F.lit("")) == "") & (F.coalesce("item1a", F.lit("")) == ""))


def is_substantial(min_chars: int = MIN_FILING_CHARS) -> Column:
    return (F.col("char_count") >= min_chars) & (tx.strip(F.coalesce("item1a", F.lit(""))) != "")


def drop_boilerplate(filings: DataFrame, min_chars: int = MIN_FILING_CHARS) -> DataFrame:
    return filings.where(is_substantial(min_chars))


def boilerplate_counts(filings: DataFrame, min_chars: int = MIN_FILING_CHARS) -> DataFrame:
    return filings.agg(F.count_if(is_substantial(min_chars)).alias("kept"),
                       F.count_if(~is_substantial(min_chars)).alias("dropped"))


def unprocessed(records: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return records.join(done.select(key), key, "left_anti")


def stage_progress(records: DataFrame) -> DataFrame:
    """``records`` has (stage, done boolean)."""
    return (records.groupBy("stage").agg(F.count("*").alias("total"), F.count_if(F.col("done")).alias("done"))
            .withColumn("status", F.when(F.col("done") >= F.col("total"), "completed").otherwise("running")))


def corpus_summary(chunks: DataFrame) -> DataFrame:
    return chunks.agg(F.countDistinct("document_id").alias("documents"), F.count("*").alias("chunks"),
                      F.round(F.avg(F.length("content")), 2).alias("mean_chunk_chars"))


def sample_documents(assertions: DataFrame, categories: DataFrame, per_category: int = 15,
                     claims: int = 4, max_chars: int = 500) -> DataFrame:
    """A seeded sample of source documents per category, with an excerpt of their best claims.

    ``categories`` maps ``source_document`` to ``category``.  The claims of a
    document are cut to its best four before they are collected.
    """
    sources = assertions.select("source_document").distinct().join(categories, "source_document")
    # A content hash stands in for a shuffled order, so that a retry draws the same sample.
    chosen = top_per_key(sources, ["category"], [F.md5("source_document"), F.col("source_document")],
                         per_category)
    best = top_per_key(
        assertions.join(chosen.select("source_document"), "source_document", "left_semi")
        .select("source_document", "assertion_id", "claim_text", "confidence"),
        ["source_document"], [F.desc("confidence"), F.col("assertion_id")], claims, rank="position")
    excerpt = (best.groupBy("source_document")
               .agg(F.array_sort(F.collect_list(F.struct("position", "claim_text"))).alias("cs"))
               .select("source_document", F.substring(
                   F.array_join(F.transform("cs", lambda c: c["claim_text"]), " "), 1, max_chars)
                   .alias("excerpt")))
    return chosen.join(excerpt, "source_document").select("category", "source_document", "excerpt")


def stratified_queries(pool: DataFrame, per_category: int = 10, per_type: int = 50) -> DataFrame:
    """Up to ``per_category`` queries per type and category, then filled up to ``per_type``.

    Both ranks only matter up to ``per_type``, so each is a bounded top-k.
    """
    first = top_per_key(pool, ["epistemic_type", "source_category"], [F.col("query_id")], per_category)
    rest = pool.join(first.select("query_id"), "query_id", "left_anti")
    both = first.withColumn("tier", F.lit(0)).unionByName(rest.withColumn("tier", F.lit(1)))
    return top_per_key(both, ["epistemic_type"], [F.col("tier"), F.col("query_id")], per_type).drop("tier")


def expand_templates(templates: DataFrame, values: DataFrame, per_type: dict[str, int]) -> DataFrame:
    """Fill templates by cycling through templates and values of a type.

    ``templates`` (epistemic_type, template) uses ``{topic}``; ``values`` has
    (value).  Either may have any number of rows: no more than the largest count in
    ``per_type`` are ever reached, so the first of each are numbered and joined.
    """
    spark = templates.sparkSession
    most = max(per_type.values(), default=0)
    wanted = spark.createDataFrame(list(per_type.items()), "epistemic_type string, n int").where("n > 0")
    counts = templates.groupBy("epistemic_type").agg(F.count("*").alias("n_templates"))
    first = top_per_key(templates, ["epistemic_type"], [F.col("template")], most, rank="t")
    topics = values.orderBy("value").limit(most).select("value", F.row_number().over(Window.orderBy("value")).alias("v"))
    numbers = (wanted.join(counts, "epistemic_type").withColumn("n_values", values.agg(F.count("*")).scalar())
               .select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("number"))
               .select("epistemic_type", "number", (F.col("number") % F.col("n_templates") + 1).alias("t"),
                       (F.expr("number % nullif(n_values, 0)") + 1).alias("v")))
    return (numbers.join(first, ["epistemic_type", "t"]).join(topics, "v")
            .select("epistemic_type", "number", F.replace("template", F.lit("{topic}"), "value").alias("query_text")))
