"""Property graph as node and edge DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.operators.assertions import positive_or

# Outgoing logical edge types shown with one assertion.
SHOWN_TYPES = ["ENTAILS", "CAUSES", "DEFINES", "TRIGGERS", "SPECIALIZES", "SUPERSEDES", "EQUIVALENT",
               "INHIBITS", "CORRELATES_WITH", "GENERALIZES", "INSTANTIATES", "CLASSIFIES", "PRECEDES",
               "OPERATIONALIZES", "LOGICAL_RELATION"]
# Display classes of edge types.
EDGE_CLASSES = {
    "deductive": ["ENTAILS", "EQUIVALENT", "DEFINES", "TRIGGERS", "SUPERSEDES", "SPECIALIZES", "GENERALIZES"],
    "causal": ["CAUSES", "INHIBITS"],
    "empirical": ["CORRELATES_WITH"],
    "conflict": ["CONTRADICTS", "DUPLICATE_OF"],
    "structural": ["SOURCED_FROM", "CHUNK_OF", "GOVERNS", "REFERENCES", "TAGGED_WITH", "INSTANTIATES",
                   "CLASSIFIES", "PRECEDES", "OPERATIONALIZES", "LOGICAL_RELATION"],
}


def document_nodes(docs: DataFrame) -> DataFrame:
    return docs.select("document_id", "title", "source_document", "domain").dropDuplicates(["document_id"])


def chunk_edges(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """CHUNK_OF edges; a chunk of an unknown document stays without one."""
    return chunks.select("chunk_id", "document_id").join(docs.select("document_id"), "document_id", "left_semi")


def source_edges(assertions: DataFrame, chunks: DataFrame) -> DataFrame:
    """SOURCED_FROM edges from assertions to existing chunks."""
    return assertions.select("assertion_id", "chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_semi")


def name_edges(assertions: DataFrame, column: str) -> DataFrame:
    """Edges to names in an array column: once per assertion and name, empty names skipped."""
    return (assertions.select("assertion_id", F.explode(F.array_distinct(column)).alias("name"))
            .where("name <> ''"))


def name_nodes(edges: DataFrame) -> DataFrame:
    return edges.select("name").distinct()


def _with_ends(edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """Edges whose ends both exist."""
    ids = assertions.select("assertion_id")
    return (edges.join(ids.withColumnRenamed("assertion_id", "dst"), "dst", "left_semi")
            .join(ids.withColumnRenamed("assertion_id", "src"), "src", "left_semi"))


def logical_edges(relations: DataFrame, assertions: DataFrame) -> DataFrame:
    """One edge per (source, type, target) with the properties of the first relation.

    The dedup key spreads a hub over all tasks and combines before the shuffle;
    the existence joins come after it, on fewer rows.
    """
    props = F.struct("relationship_id", positive_or(F.col("confidence")).alias("confidence"),
                     "is_truth_preserving", "is_defeasible", "is_bidirectional",
                     *[F.coalesce(n, F.lit("")).alias(n) for n in ("evidence_text", "mechanism", "strength")])
    first = (relations.groupBy(F.col("source_assertion_id").alias("src"), F.col("relation_type").alias("type"),
                               F.col("target_assertion_id").alias("dst"))
             .agg(F.min_by(props, "relationship_id").alias("p")))
    return _with_ends(first, assertions).select("src", "dst", "type", "p.*")


def conflict_edges(conflicts: DataFrame, assertions: DataFrame) -> DataFrame:
    """DUPLICATE_OF for duplicates and CONTRADICTS for every other verdict; the last row wins."""
    kind = F.when(F.col("relationship_type") == "DUPLICATE", "DUPLICATE_OF").otherwise("CONTRADICTS")
    props = F.struct("relationship_id", positive_or(F.col("confidence")).alias("confidence"),
                     F.col("relationship_type").alias("conflict_type"),
                     F.coalesce("review_status", F.lit("pending")).alias("review_status"))
    last = (conflicts.groupBy(F.col("source_assertion_id").alias("src"), kind.alias("type"),
                              F.col("target_assertion_id").alias("dst"))
            .agg(F.max_by(props, "relationship_id").alias("p")))
    return _with_ends(last, assertions).select("src", "dst", "type", "p.*")


def assertion_edges(relations: DataFrame, conflicts: DataFrame, assertions: DataFrame) -> DataFrame:
    """All edges between assertions.

    A conflict verdict merges into a logical CONTRADICTS edge on the same ends
    and overwrites its confidence.  Only that type needs the outer join.
    """
    logical = logical_edges(relations, assertions)
    verdicts = conflict_edges(conflicts, assertions)
    plain = logical.where("type <> 'CONTRADICTS'")
    both = logical.where("type = 'CONTRADICTS'").alias("l").join(
        verdicts.withColumnRenamed("confidence", "verdict_confidence")
        .withColumnRenamed("relationship_id", "verdict_id"), ["src", "dst", "type"], "full_outer")
    merged = both.select(
        "src", "dst", "type", F.coalesce(F.col("relationship_id") * 2, F.col("verdict_id") * 2 + 1).alias("edge_id"),
        F.coalesce("verdict_confidence", "confidence").alias("confidence"), "is_truth_preserving", "is_defeasible",
        F.coalesce("evidence_text", F.lit("")).alias("evidence_text"), F.coalesce("mechanism", F.lit("")).alias("mechanism"),
        F.coalesce("strength", F.lit("")).alias("strength"), "conflict_type", "review_status")
    return merged.unionByName(plain.select(
        "src", "dst", "type", (F.col("relationship_id") * 2).alias("edge_id"), "confidence", "is_truth_preserving",
        "is_defeasible", "evidence_text", "mechanism", "strength"), allowMissingColumns=True)


def typed_id(label: str, key: str | Column) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit(label + ":"), key.cast("string"))


def all_edges(edges: DataFrame, assertions: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Every edge of the graph over labelled text ids, with a text ``edge_id``."""
    parts = [edges.select(typed_id("A", "src").alias("src"), typed_id("A", "dst").alias("dst"), "type",
                          F.concat(F.lit("L"), F.lpad(F.col("edge_id").cast("string"), 20, "0")).alias("edge_id")),
             _structural("CHUNK_OF", chunk_edges(chunks, docs), "C", "chunk_id", "D", "document_id"),
             _structural("SOURCED_FROM", source_edges(assertions, chunks), "A", "assertion_id", "C", "chunk_id")]
    for kind, column, label in [("TAGGED_WITH", "topics", "T"), ("GOVERNS", "entities", "K"),
                                ("REFERENCES", "regulations", "R")]:
        parts.append(_structural(kind, name_edges(assertions, column), "A", "assertion_id", label, "name"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _structural(kind: str, rows: DataFrame, src_label: str, src: str, dst_label: str, dst: str) -> DataFrame:
    return rows.select(typed_id(src_label, src).alias("src"), typed_id(dst_label, dst).alias("dst"),
                       F.lit(kind).alias("type"),
                       F.concat_ws("|", F.lit(kind), F.col(src).cast("string"), F.col(dst).cast("string")).alias("edge_id"))


def edge_class(kind: Column) -> Column:
    out = None
    for name, types in EDGE_CLASSES.items():
        hit = kind.isin(types)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def edges_of_classes(edges: DataFrame, shown: list[str]) -> DataFrame:
    """Edges to draw: types outside every class stay; one per (source, target, type)."""
    return (edges.where(edge_class(F.col("type")).isin(shown + ["other"]))
            .select("src", "dst", "type").distinct())
