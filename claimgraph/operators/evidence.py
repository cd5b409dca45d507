"""Evidence around results: contradictions, regulation anchors and two-pass retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.operators.assertions import live, positive_or
from claimgraph.session import few


def table_contradictions(results: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Unrejected CONTRADICTS rows with both ends among a query's results.

    ``results`` is (query_id, assertion_id), distinct per query.
    """
    kept = conflicts.where("relationship_type = 'CONTRADICTS' and review_status <> 'false_positive'")
    return _both_ends(results, kept.select(F.col("source_assertion_id").alias("src"), F.col("target_assertion_id").alias("dst"),
                                           "relationship_id"))


def graph_contradictions(results: DataFrame, edges: DataFrame) -> DataFrame:
    """Directed CONTRADICTS edges of the graph within a query's results."""
    return _both_ends(results, edges.where("type = 'CONTRADICTS'").select("src", "dst"))


def _both_ends(results: DataFrame, pairs: DataFrame) -> DataFrame:
    ids = few(results.select("query_id", "assertion_id").distinct())
    left = ids.withColumnRenamed("assertion_id", "src")
    right = ids.withColumnRenamed("assertion_id", "dst")
    return left.join(pairs, "src").join(right, ["query_id", "dst"])


def cross_source_contradictions(results: DataFrame, edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """Graph contradictions between different source documents."""
    docs = assertions.select("assertion_id", "source_document")
    src_docs = docs.select(F.col("assertion_id").alias("src"), F.col("source_document").alias("src_doc"))
    return (few(few(graph_contradictions(results, edges)).join(src_docs, "src"))
            .join(docs.select(F.col("assertion_id").alias("dst"), F.col("source_document").alias("dst_doc")), "dst")
            .where("src_doc <> dst_doc"))


def _citing(citations: DataFrame, assertions: DataFrame, *more: str) -> DataFrame:
    """Live assertions per regulation name they cite, with ``more`` of their columns."""
    return citations.join(assertions.where(live()).select("assertion_id", "source_document", "confidence", *more), "assertion_id")


def authorities(per_document: DataFrame) -> DataFrame:
    """The document that cites a regulation most; the smaller name on a tie."""
    order = F.struct(-F.col("n"), F.col("source_document"))
    return per_document.groupBy("name").agg(F.min_by("source_document", order).alias("authority"))


def regulation_periphery(seeds: DataFrame, citations: DataFrame, assertions: DataFrame, limit: int = 15) -> DataFrame:
    """Assertions from other documents that cite the seeds' most cited regulation.

    ``seeds`` holds the first seeds of each query.  Citations are counted per
    (regulation, document) once, for regulations the seeds cite; a regulation
    keeps its ``limit`` best peripheral rows, so a hub never meets the queries whole.
    """
    candidates = few(few(seeds.select("query_id", "assertion_id")).join(citations, "assertion_id").select("query_id", "name").distinct())
    wanted = citations.join(candidates.select("name"), "name", "left_semi")
    citing = _citing(wanted, assertions)
    per_document = citing.groupBy("name", "source_document").agg(F.count("*").alias("n"))
    totals = per_document.groupBy("name").agg(F.sum("n").alias("n"))
    chosen = (candidates.join(totals, "name", "left").groupBy("query_id")
              .agg(F.min_by("name", F.struct(-F.coalesce("n", F.lit(0)), F.col("name"))).alias("name")))
    outer = citing.join(authorities(per_document), "name").where("source_document <> authority")
    best = top_per_key(outer, ["name"], [F.desc("confidence"), F.col("assertion_id")], limit, rank="position")
    return chosen.join(best, "name").select("query_id", F.col("name").alias("regulation"), "authority", "assertion_id", "position")


def regulation_context(seeds: DataFrame, citations: DataFrame, assertions: DataFrame, per_layer: int = 5) -> DataFrame:
    """Warrant, ground and backing layers around the regulation with most peripheral assertions.

    ``seeds`` is (query_id, rank, assertion_id, source_document).  A regulation is
    counted against the document of the first seed that cites it: live citing
    assertions of other documents, provided that document cites it at all.
    """
    cited = seeds.select("query_id", "rank", "assertion_id", "source_document").join(citations, "assertion_id")
    first = (cited.groupBy("query_id", "name")
             .agg(F.min_by("source_document", F.struct("rank", "assertion_id")).alias("seed_doc")))
    citing = _citing(citations, assertions, "discourse_role", "validity_claim_type", "claim_text").join(first.select("name").distinct(), "name", "left_semi")
    per_document = citing.groupBy("name", "source_document").agg(F.count("*").alias("n"))
    totals = per_document.groupBy("name").agg(F.sum("n").alias("total"))
    own = per_document.select("name", F.col("source_document").alias("seed_doc"), F.col("n").alias("own"))
    counted = (first.join(totals, "name", "left").join(own, ["name", "seed_doc"], "left")
               .withColumn("peripheral", F.coalesce(F.col("total"), F.lit(0)) - F.coalesce(F.col("own"), F.lit(0))))
    chosen = (counted.groupBy("query_id")
              .agg(F.min_by(F.struct("name", "peripheral"), F.struct(-F.col("peripheral"), F.col("name"))).alias("best"))
              .where("best.peripheral > 0").select("query_id", F.col("best.name").alias("name")))
    placed = citing.join(authorities(per_document), "name")
    inside = F.col("source_document") == F.col("authority")
    role = F.col("discourse_role")
    # Authority rows rank warrants first, so the layer falls back to any role only without a warrant.
    layer = (F.when(inside & (role == "warrant"), "warrant").when(inside, "fallback")
             .when(role == "ground", "ground").when(role == "backing", "backing"))
    best = top_per_key(placed.withColumn("layer", layer).where("layer is not null"), ["name", "layer"],
                       [F.desc("confidence"), F.col("assertion_id")], per_layer, rank="position")
    with_warrant = best.where("layer = 'warrant'").select("name").distinct()
    fallback = best.where("layer = 'fallback'").join(with_warrant, "name", "left_anti").withColumn("layer", F.lit("warrant"))
    layers = best.where("layer <> 'fallback'").unionByName(fallback)
    return (chosen.join(layers, "name")
            .select("query_id", F.col("name").alias("regulation"), "authority", "layer", "position", "assertion_id",
                    "source_document", "discourse_role", "validity_claim_type",
                    positive_or(F.col("confidence")).alias("confidence"), "claim_text"))


def context_sources(context: DataFrame) -> DataFrame:
    """Contributing documents in order; a context holds at most fifteen rows."""
    return (context.groupBy("query_id", "regulation")
            .agg(F.array_join(F.array_sort(F.collect_set("source_document")), ", ").alias("source_documents")))
