"""Corpus, document and node analytics over the claim graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.functions.selection import cumulative, middle
from claimgraph.functions.text import confidence_bucket, conflict_domain, map_category

# Confidences are added in hundred-millionths.
UNIT = 10 ** 8
# Edge types that make a seed eligible.
SEED_EDGE_TYPES = ["ENTAILS", "CAUSES", "SPECIALIZES", "TRIGGERS", "INHIBITS", "REBUTS"]


def count_where(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def edge_ends(*edge_tables: DataFrame) -> DataFrame:
    """One row per (edge, end): ``assertion_id`` of both ends of every edge.

    Reads each edge table once; ``explode`` doubles the rows inside the stage.
    """
    out = None
    for edges in edge_tables:
        ends = edges.select(F.explode(F.array("source_assertion_id", "target_assertion_id"))
                            .alias("assertion_id"))
        out = ends if out is None else out.unionByName(ends)
    return out


def document_readiness(docs: DataFrame, assertions: DataFrame, relations: DataFrame,
                       conflicts: DataFrame) -> DataFrame:
    """Counts by role and validity, conflicts at either end, isolation and the readiness score.

    Edges are reduced to one row per assertion before they meet the assertions,
    so a hub assertion or a document with a third of all rows costs one partial
    aggregate per task, never one task per key.
    """
    linked = edge_ends(relations).distinct().withColumn("linked", F.lit(True))
    in_conflict = (edge_ends(conflicts.where("relationship_type = 'CONTRADICTS'"))
                   .groupBy("assertion_id").agg(F.count("*").alias("conflict_ends")))
    per_doc = (
        assertions.select("assertion_id", "document_id", "discourse_role", "validity_claim_type")
        .join(linked, "assertion_id", "left").join(in_conflict, "assertion_id", "left")
        .groupBy("document_id").agg(
            F.count("*").alias("assertion_count"),
            count_where(F.col("discourse_role") == "warrant").alias("warrant_count"),
            count_where(F.col("discourse_role") == "ground").alias("ground_count"),
            count_where(F.col("discourse_role") == "claim").alias("claim_count"),
            count_where(F.col("validity_claim_type") == "normative").alias("normative_count"),
            count_where(F.col("validity_claim_type") == "expressive").alias("expressive_count"),
            count_where(F.col("linked").isNull()).alias("isolated_count"),
            F.coalesce(F.sum("conflict_ends"), F.lit(0)).cast("bigint").alias("conflict_count")))
    counts = [c for c in per_doc.columns if c != "document_id"]
    n = F.col("assertion_count")
    floor1 = F.greatest(n, F.lit(1))
    # A document without assertions counts as not isolated.
    score = (F.least(n / 150, F.lit(1.0)) * 0.3
             + (F.col("normative_count") + F.col("ground_count")) / floor1 * 0.5
             + (1 - F.col("isolated_count") / floor1) * 0.2)
    return (docs.select("document_id", "title").join(per_doc, "document_id", "left")
            .select("document_id", "title", map_category(F.col("title")).alias("category"),
                    *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts])
            .withColumn("ai_readiness_score", F.round(score, 3)))


def document_pair_edges(assertions: DataFrame, relations: DataFrame, conflicts: DataFrame, digits: int = 3) -> DataFrame:
    """Relations between documents per type, from both edge tables.

    Edges are counted per assertion pair by the partial aggregate before the
    final shuffle on (document, document, type).
    """
    both = (relations.select("source_assertion_id", "target_assertion_id", F.col("relation_type").alias("rel_type"), "confidence")
            .unionByName(conflicts.select("source_assertion_id", "target_assertion_id",
                                          F.col("relationship_type").alias("rel_type"), "confidence")))
    src = assertions.select(F.col("assertion_id").alias("source_assertion_id"), F.col("document_id").alias("source_doc"))
    tgt = assertions.select(F.col("assertion_id").alias("target_assertion_id"), F.col("document_id").alias("target_doc"))
    return (both.join(src, "source_assertion_id").join(tgt, "target_assertion_id")
            .where("source_doc <> target_doc or rel_type = 'CONTRADICTS'")
            .groupBy("source_doc", "target_doc", "rel_type")
            .agg(F.count("*").alias("edge_count"), F.count("confidence").alias("n"),
                 F.coalesce(F.sum(F.round(F.col("confidence") * UNIT).cast("bigint")), F.lit(0)).alias("u"))
            .select("source_doc", "target_doc", "rel_type", "edge_count", _mean_of_units("u", "n", digits).alias("mean_confidence")))


def _mean_of_units(total: str, n: str, digits: int) -> Column:
    """Mean of whole units, halves rounded up.

    Whole numbers do not depend on the order in which tasks deliver rows, nor on
    how a half is held in binary.
    """
    step = UNIT // 10 ** digits
    return F.coalesce(F.expr(f"try_divide((2 * {total} + {n} * {step}L) div nullif(2 * {n} * {step}L, 0), {10 ** digits}D)"), F.lit(0.0))


def top_concepts(concept_edges: DataFrame, n: int = 20) -> DataFrame:
    return (concept_edges.groupBy("name").agg(F.count("*").alias("degree"))
            .orderBy(F.desc("degree"), "name").limit(n))


def top_regulations(regulation_edges: DataFrame, assertions: DataFrame, n: int = 20) -> DataFrame:
    roles = assertions.select("assertion_id", "discourse_role", "source_document")
    # Counting per (name, document) first keeps the distinct count out of one task per hub.
    per_doc = (regulation_edges.join(roles, "assertion_id").groupBy("name", "source_document")
               .agg(F.count("*").alias("n"), count_where(F.col("discourse_role") == "warrant").alias("w")))
    return (per_doc.groupBy("name").agg(F.sum("n").alias("assertion_count"), F.sum("w").alias("warrants"),
                                        F.count("source_document").alias("doc_count"))
            .orderBy(F.desc("assertion_count"), "name").limit(n))


def assertion_degrees(relations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Number of edge ends per assertion over both edge tables."""
    return edge_ends(relations, conflicts).groupBy("assertion_id").agg(F.count("*").alias("degree"))


def top_assertions(assertions: DataFrame, degrees: DataFrame, n: int = 20) -> DataFrame:
    return (assertions.select("assertion_id", "claim_text", "discourse_role", "validity_claim_type", "document_id")
            .join(degrees, "assertion_id").orderBy(F.desc("degree"), "assertion_id").limit(n))


def top_document_assertions(assertions: DataFrame, degrees: DataFrame, n: int = 40) -> DataFrame:
    """For every document its assertions of highest degree, degree 0 included."""
    ranked = (assertions.select("document_id", "assertion_id", "discourse_role", "validity_claim_type", "confidence")
              .join(degrees, "assertion_id", "left").fillna({"degree": 0}))
    return top_per_key(ranked, ["document_id"], [F.desc("degree"), F.col("assertion_id")], n)


def corpus_counters(docs: DataFrame, chunks: DataFrame, assertions: DataFrame, relations: DataFrame,
                    conflicts: DataFrame, items: DataFrame) -> DataFrame:
    pending = items.join(conflicts.where("review_status = 'pending'"), "relationship_id", "left_semi")
    out = None
    for name, rows in [("documents", docs), ("chunks", chunks), ("assertions", assertions),
                       ("logical_relationships", relations), ("conflicts", conflicts), ("pending_conflicts", pending)]:
        count = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
        out = count if out is None else out.unionByName(count)
    return out


def edge_distribution(assertions: DataFrame, edges: DataFrame) -> DataFrame:
    """Per source document: connected and isolated assertions and mean out-degree over six types."""
    out_degree = (edges.where(F.col("type").isin(SEED_EDGE_TYPES)).groupBy(F.col("src").alias("assertion_id"))
                  .agg(F.count("*").alias("degree")))
    return (assertions.select("assertion_id", "source_document").join(out_degree, "assertion_id", "left")
            .fillna({"degree": 0}).groupBy("source_document")
            .agg(F.count("*").alias("assertions"), count_where(F.col("degree") > 0).alias("connected"),
                 count_where(F.col("degree") == 0).alias("isolated"),
                 F.round(F.avg("degree"), 6).alias("avg_out_degree")))


def seed_eligibility(seeds: DataFrame, edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """Per seed: directed and undirected neighbours over six edge types, and why it fails.

    ``seeds`` is (query_id, assertion_id).  Edges are cut to the seeds' before counting.
    """
    kept = edges.where(F.col("type").isin(SEED_EDGE_TYPES)).select("src", "dst")
    ids = seeds.select("assertion_id").distinct()
    outward = (kept.join(ids, kept.src == ids.assertion_id, "left_semi").groupBy(F.col("src").alias("assertion_id"))
               .agg(F.count("*").alias("directed")))
    inward = (kept.join(ids, kept.dst == ids.assertion_id, "left_semi").groupBy(F.col("dst").alias("assertion_id"))
              .agg(F.count("*").alias("inward")))
    known = assertions.select("assertion_id", "source_document")
    return (seeds.join(known, "assertion_id", "left").join(outward, "assertion_id", "left")
            .join(inward, "assertion_id", "left").fillna({"directed": 0, "inward": 0})
            .withColumn("undirected", F.col("directed") + F.col("inward")).drop("inward")
            .withColumn("outcome", F.when(F.col("directed") > 0, "eligible")
                        .when(F.col("undirected") > 0, "direction_failure").otherwise("true_sparse")))


def eligibility_report(eligibility: DataFrame) -> DataFrame:
    total = F.count("*")
    return eligibility.agg(
        total.alias("total_queries"), count_where(F.col("directed") > 0).alias("eligible_directed"),
        count_where(F.col("undirected") > 0).alias("eligible_undirected"),
        count_where(F.col("source_document").isNull()).alias("seed_missing"),
        count_where(F.col("outcome") == "direction_failure").alias("direction_failures"),
        count_where(F.col("outcome") == "true_sparse").alias("true_sparse"),
        F.round(count_where(F.col("undirected") > 0) / total * 100, 1).alias("corrected_pct"))


def failures_by_document(eligibility: DataFrame, n: int = 10) -> DataFrame:
    counts = (eligibility.where("outcome <> 'eligible'").groupBy("outcome", "source_document")
              .agg(F.count("*").alias("seeds")))
    return top_per_key(counts, ["outcome"], [F.desc("seeds"), F.col("source_document")], n)


def gini(values: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """Gini coefficient of non-negative values per key; 0 where empty or all zero.

    Equal values are counted first, distinct ones are ranked in pieces, and a run of
    equal values adds its rank sum in closed form.
    """
    counted = values.groupBy(*keys, value).agg(F.count("*").alias("c"))
    v, c, s = F.col(value).cast("double"), F.col("c"), F.col("smaller")
    ranked = cumulative(counted, keys, value, F.col("c"), "smaller").withColumn("weighted", v * (c * s + c * (c + 1) / 2))
    n, total = F.sum("c"), F.sum(v * c)
    score = F.when(total > 0, F.round(2 * F.sum("weighted") / (n * total) - (n + 1) / n, digits)).otherwise(F.lit(0.0))
    return ranked.groupBy(*keys).agg(score.alias("gini"))


def warrants_by_document(regulation_edges: DataFrame, assertions: DataFrame) -> DataFrame:
    roles = assertions.select("assertion_id", "discourse_role", "source_document")
    return (regulation_edges.join(roles, "assertion_id").groupBy(F.col("name").alias("regulation"), "source_document")
            .agg(F.count("*").alias("total"), count_where(F.col("discourse_role") == "warrant").alias("warrants")))


def warrant_monopoly(per_document: DataFrame, min_documents: int = 3) -> DataFrame:
    """Concentration of warrants over documents, per regulation cited by enough documents."""
    clusters = (per_document.groupBy("regulation").agg(
        F.count("*").alias("doc_count"), F.sum("warrants").alias("total_warrants"), F.sum("total").alias("total_assertions"),
        F.min_by(F.struct("source_document", "warrants"), F.struct(-F.col("warrants"), "source_document")).alias("top"))
        .where((F.col("doc_count") >= min_documents) & (F.col("total_warrants") > 0)))
    return (clusters.join(gini(per_document, ["regulation"], "warrants"), "regulation")
            .select("regulation", "doc_count", "total_warrants", "total_assertions", "gini",
                    F.col("top.source_document").alias("authoritative_source"),
                    F.round(F.col("top.warrants") / F.greatest(F.col("total_warrants"), F.lit(1)), 4)
                    .alias("authoritative_share")))


def monopoly_summary(clusters: DataFrame) -> DataFrame:
    """Upper-middle median, mean and tail shares of the Gini values."""
    upper = middle(clusters, [], "gini").select(F.round("high", 4).alias("median_gini"))
    means = clusters.agg(
        F.count("*").alias("clusters"),
        F.round(F.avg("gini"), 4).alias("mean_gini"),
        F.round(F.avg(F.when(F.col("gini") > 0.80, 1.0).otherwise(0.0)), 4).alias("share_monopoly"),
        F.round(F.avg(F.when(F.col("gini") < 0.40, 1.0).otherwise(0.0)), 4).alias("share_distributed"))
    return means.withColumn("median_gini", upper.scalar())


def contradiction_rows(edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """CONTRADICTS edges with the texts and types of both ends."""
    cols = ["assertion_id", "claim_text", "discourse_role", "validity_claim_type", "source_document"]
    src = assertions.select(*[F.col(c).alias(f"src_{c}") for c in cols])
    tgt = assertions.select(*[F.col(c).alias(f"tgt_{c}") for c in cols])
    kept = edges.where("type = 'CONTRADICTS'").select("src", "dst", "confidence", "evidence_text")
    return (kept.join(src, F.col("src") == F.col("src_assertion_id")).join(tgt, F.col("dst") == F.col("tgt_assertion_id"))
            .select("src", "dst", F.substring("src_claim_text", 1, 120).alias("src_text"),
                    F.substring("tgt_claim_text", 1, 120).alias("tgt_text"),
                    F.col("src_source_document").alias("src_doc"), F.col("tgt_source_document").alias("tgt_doc"),
                    F.concat_ws("_vs_", F.coalesce("src_validity_claim_type", F.lit("None")),
                                F.coalesce("tgt_validity_claim_type", F.lit("None"))).alias("pairing"),
                    "confidence", F.substring("evidence_text", 1, 300).alias("evidence"),
                    (~F.col("src_source_document").eqNullSafe(F.col("tgt_source_document"))).alias("cross_document")))


def contradiction_profile(rows: DataFrame) -> DataFrame:
    """Counts in every section of the profile in one pass over the contradictions."""
    section = lambda name, key: F.struct(F.lit(name).alias("section"), key.alias("key"))
    expressive = F.contains(F.col("pairing"), F.lit("expressive"))
    sections = F.array_compact(F.array(
        section("total", F.lit("all")),
        section("scope", F.when(F.col("cross_document"), "cross_document").otherwise("within_document")),
        section("pairing", F.col("pairing")),
        F.when(expressive, section("expressive", F.lit("involved"))),
        section("confidence", confidence_bucket(F.col("confidence"))),
        section("domain", conflict_domain(F.col("src_doc")))))
    return (rows.select(F.explode(sections).alias("s")).groupBy("s.section", "s.key").agg(F.count("*").alias("n")))


def top_contradictions(rows: DataFrame, n: int = 10) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("confidence"), "src", "dst").limit(n)


def regulatory_view(nodes: DataFrame, pair_edges: DataFrame) -> DataFrame:
    """Regulatory documents and their immediate neighbours."""
    core = nodes.where("category = 'regulatory'").select("document_id")
    touching = (pair_edges.join(core, pair_edges.source_doc == core.document_id, "left_semi")
                .select(F.col("target_doc").alias("document_id"))
                .unionByName(pair_edges.join(core, pair_edges.target_doc == core.document_id, "left_semi")
                             .select(F.col("source_doc").alias("document_id"))))
    return nodes.join(core.unionByName(touching).distinct(), "document_id", "left_semi")


def conflict_view(nodes: DataFrame, pair_edges: DataFrame) -> DataFrame:
    ends = (pair_edges.where("rel_type = 'CONTRADICTS'")
            .select(F.explode(F.array("source_doc", "target_doc")).alias("document_id")).distinct())
    return nodes.join(ends, "document_id", "left_semi")


def ready_view(nodes: DataFrame, minimum: float = 0.7) -> DataFrame:
    return nodes.where(F.col("ai_readiness_score") >= minimum)


def confident_edges(pair_edges: DataFrame, minimum: float = 0.65) -> DataFrame:
    return pair_edges.where(F.col("mean_confidence") >= minimum)


def composition(assertions: DataFrame) -> DataFrame:
    """Share of each validity type per corpus; ``assertions`` has ``corpus``.

    Totals come from the per-type counts, so the rows are read once.
    """
    counts = assertions.groupBy("corpus", "validity_claim_type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("corpus"))
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def composition_side_by_side(shares: DataFrame, corpora: list[str]) -> DataFrame:
    return (shares.groupBy("validity_claim_type").pivot("corpus", corpora).agg(F.first("share"))
            .fillna(0.0, corpora))


def assertions_per_document(assertions: DataFrame) -> DataFrame:
    per_doc = assertions.groupBy("corpus", "document_id").agg(F.count("*").alias("n"))
    return per_doc.groupBy("corpus").agg(F.count("*").alias("documents"), F.sum("n").alias("assertions"),
                                         F.round(F.avg("n"), 6).alias("per_document"))
