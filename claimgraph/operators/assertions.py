"""Assertion and relation clean-up, batching and cross-document candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph import schemas as S
from claimgraph.functions.ranking import running, sort_bucket, top_per_key
from claimgraph.functions.text import strip

BATCH_ROWS = 50
CROSS_ROWS = 10
MIN_ASSERTIONS_WITH_RELATIONS = 30
MIN_CLUSTER, MAX_CLUSTER = 2, 50
# Members of a concept that meet in one cell of the pair join: at most this many of each of two blocks.
BLOCK_MEMBERS = 1024
# Rows of one document that a single task may sort when batches are numbered.
ORDER_BUCKET = 65_536


def live(status: str | Column = "epistemic_status") -> Column:
    """Deprecated and orphaned assertions are dead; a null status is neither."""
    col = F.col(status) if isinstance(status, str) else status
    return ~F.coalesce(col, F.lit("")).isin(S.DEAD_STATUSES)


def dedup_assertions(assertions: DataFrame, key_chars: int | None = None) -> DataFrame:
    """One assertion per chunk and normalised claim: a specific predicate beats ``relates_to``.

    Claims are compared whole, or by their first ``key_chars`` characters.
    """
    claim = F.lower(strip(F.col("claim_text")))
    key = claim if key_chars is None else F.substring(claim, 1, key_chars)
    rank = F.when(F.col("predicate_type") == "relates_to", 99).otherwise(1)
    return top_per_key(assertions.withColumn("_key", key), ["chunk_id", "_key"],
                       [rank, F.col("assertion_id")], 1).drop("_key")


def merge_grammar(assertions: DataFrame, grammar: DataFrame) -> DataFrame:
    """Grammar values win over own values; unknown enum values become ``unclassified``."""
    g = grammar.select("assertion_id", F.col("discourse_role").alias("_role"),
                       F.col("validity_claim_type").alias("_type"))

    def pick(new: str, old: str, allowed: list[str]) -> Column:
        value = F.coalesce(F.nullif(F.col(new), F.lit("")), F.nullif(F.col(old), F.lit("")))
        return F.when(value.isin(allowed), value).otherwise("unclassified")

    return (assertions.join(g, "assertion_id", "left")
            .withColumn("discourse_role", pick("_role", "discourse_role", S.DISCOURSE_ROLES))
            .withColumn("validity_claim_type", pick("_type", "validity_claim_type", S.VALIDITY_TYPES))
            .drop("_role", "_type"))


def invalid_grammar(grammar: DataFrame) -> DataFrame:
    """How many values fall outside the enumerations."""
    bad_role = ~F.col("discourse_role").isin(S.DISCOURSE_ROLES)
    bad_type = ~F.col("validity_claim_type").isin(S.VALIDITY_TYPES)
    return grammar.agg(F.count_if(bad_role).alias("unknown_roles"), F.count_if(bad_type).alias("unknown_types"))


def positive_or(confidence: Column, default: float = 0.8) -> Column:
    """Confidence where null and 0 both mean ``default``."""
    return F.coalesce(F.when(confidence != 0.0, confidence), F.lit(default))


def read_defaults(assertions: DataFrame) -> DataFrame:
    return (assertions.withColumn("confidence", positive_or(F.col("confidence")))
            .withColumn("validity_claim_type", F.coalesce("validity_claim_type", F.lit("unclassified")))
            .withColumn("discourse_role", F.coalesce("discourse_role", F.lit("unclassified"))))


def relation_flags(relation_type: str = "relation_type") -> list[Column]:
    kind = F.col(relation_type)
    return [kind.isin(S.TRUTH_PRESERVING).alias("is_truth_preserving"),
            kind.isin(S.DEFEASIBLE).alias("is_defeasible"),
            kind.isin(S.BIDIRECTIONAL).alias("is_bidirectional")]


def dedup_relations(relations: DataFrame) -> DataFrame:
    return top_per_key(relations, ["source_assertion_id", "target_assertion_id", "relation_type"],
                       [F.col("relationship_id")], 1)


def batches(rows: DataFrame, group: str, position: Column, size: int = BATCH_ROWS,
            bucket: Column | None = None) -> DataFrame:
    """Number rows of a group into batches of ``size`` in order of ``position``.

    ``position`` is a whole number.  Rows are counted per bucket of positions
    first, so a group with a third of all rows spreads over many tasks.
    """
    numbered = running(rows, [group], [position], bucket if bucket is not None else sort_bucket(position, ORDER_BUCKET),
                       {"_n": F.lit(1)})
    return (numbered.withColumn("batch", F.floor((F.col("_n") - 1) / size))
            .withColumn("in_batch", (F.col("_n") - 1) % size).drop("_n"))


def working_batches(rows: DataFrame, group: str, position: Column, size: int = BATCH_ROWS) -> DataFrame:
    """Batches of at least two rows."""
    marked = batches(rows, group, position, size)
    count = F.count("*").over(Window.partitionBy(group, "batch"))
    return marked.withColumn("batch_rows", count).where("batch_rows >= 2")


def cross_batches(rows: DataFrame, group: str, position: Column, size: int = BATCH_ROWS,
                  overlap: int = CROSS_ROWS) -> DataFrame:
    """The last rows of each batch with the first rows of the next.

    A row belongs to the window it opens (end of its batch) and the one it
    closes (start of its batch); the last batch opens none.
    """
    marked = batches(rows, group, position, size)
    count = F.count("*").over(Window.partitionBy(group, "batch"))
    marked = marked.withColumn("_rows", count)
    last = marked.groupBy(group).agg(F.max("batch").alias("_last"))
    sides = F.array_compact(F.array(
        F.when((F.col("_rows") - F.col("in_batch") <= overlap) & (F.col("batch") < F.col("_last")), F.col("batch")),
        F.when((F.col("in_batch") < overlap) & (F.col("batch") > 0), F.col("batch") - 1)))
    return (marked.join(last, group).withColumn("cross_batch", F.explode(sides))
            .drop("_rows", "_last", "in_batch"))


def relation_coverage(assertions: DataFrame, relations: DataFrame,
                      minimum: int = MIN_ASSERTIONS_WITH_RELATIONS) -> DataFrame:
    """Per document: counts, whether it is done, and whether it must be retried."""
    claims = assertions.groupBy("document_id").agg(F.count("*").alias("assertions"))
    found = relations.groupBy("document_id").agg(F.count("*").alias("relations"))
    done = (F.col("assertions") < minimum) | (F.col("relations") > 0)
    return (claims.join(found, "document_id", "left").fillna({"relations": 0})
            .withColumn("is_complete", done).withColumn("retry", ~done))


def concept_links(assertions: DataFrame) -> DataFrame:
    """(assertion, concept) once each, empty names skipped."""
    return (assertions.select("assertion_id", "document_id", "epistemic_status",
                              F.explode(F.array_distinct("entities")).alias("concept"))
            .where("concept <> ''"))


def clustered_links(assertions: DataFrame, low: int = MIN_CLUSTER, high: int | None = None) -> DataFrame:
    """(concept, assertion_id, document_id, size): live concept links of clusters with ``low`` to ``high`` members, a row each.

    Sizes are counted with a partial aggregate first; a concept beyond the limit is dropped by its
    count.  Without a limit every concept stays, and its members stay in rows.
    """
    links = concept_links(assertions).where(live()).drop("epistemic_status")
    sizes = links.groupBy("concept").agg(F.count("*").alias("size")).where(F.col("size") >= low)
    return links.join(sizes if high is None else sizes.where(F.col("size") <= high), "concept")


def dropped_clusters(assertions: DataFrame, low: int = MIN_CLUSTER, high: int = MAX_CLUSTER) -> DataFrame:
    """Concepts outside the size limits with their sizes: what the limits leave out."""
    links = concept_links(assertions).where(live())
    return links.groupBy("concept").agg(F.count("*").alias("size")).where(~F.col("size").between(low, high))


def concept_clusters(assertions: DataFrame, high: int = MAX_CLUSTER) -> DataFrame:
    """Clusters with their members; the size limit bounds every array.  ``clustered_links`` has clusters of any size in rows."""
    return (clustered_links(assertions, high=high).groupBy("concept", "size")
            .agg(F.array_sort(F.collect_list("assertion_id")).alias("assertion_ids")))


def pair_key(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("low_id"), F.greatest(a, b).alias("high_id")]


def linked_pairs(relations: DataFrame) -> DataFrame:
    return relations.select(*pair_key(F.col("source_assertion_id"), F.col("target_assertion_id"))).distinct()


def cluster_pairs(links: DataFrame, block: int = BLOCK_MEMBERS) -> DataFrame:
    """(concept, low_id, high_id): pairs of members from different documents of ``clustered_links``.

    A large concept is dealt into blocks of about ``block`` members, and every two blocks (and every
    block with itself) meet in a cell of their own, so no task holds a hub.
    """
    blocks = F.ceil(F.col("size") / block).cast("bigint")
    own = F.pmod(F.xxhash64("assertion_id"), blocks).alias("block")
    cell = F.explode(F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1), lambda other: F.struct(
        F.least("block", other).alias("i"), F.greatest("block", other).alias("j"))))
    dealt = (links.select("concept", "assertion_id", "document_id", blocks.alias("blocks"), own)
             .select("concept", cell.alias("cell"), "block", "assertion_id", "document_id"))
    left = dealt.select("concept", "cell", F.col("block").alias("b1"), F.col("assertion_id").alias("low_id"), F.col("document_id").alias("d1"))
    right = dealt.select("concept", "cell", F.col("block").alias("b2"), F.col("assertion_id").alias("high_id"), F.col("document_id").alias("d2"))
    once = (F.col("b1") != F.col("b2")) | (F.col("cell.i") == F.col("cell.j"))
    return (left.join(right, ["concept", "cell"])
            .where((F.col("low_id") < F.col("high_id")) & ~F.col("d1").eqNullSafe(F.col("d2")) & once)
            .select("concept", "low_id", "high_id"))


def cross_document_pairs(assertions: DataFrame, relations: DataFrame, high: int | None = None) -> DataFrame:
    """Pairs from different documents within a concept cluster that no relation links yet.

    ``high`` leaves out concepts with more members; without it, a concept with n members yields up
    to n (n - 1) / 2 pairs, made in cells of bounded size.
    """
    return (cluster_pairs(clustered_links(assertions, high=high))
            .join(linked_pairs(relations), ["low_id", "high_id"], "left_anti"))


def accept_relations(found: DataFrame, assertions: DataFrame, relations: DataFrame,
                     order: Sequence[Column]) -> DataFrame:
    """New relations between documents, the first per pair in either direction."""
    docs = assertions.select("assertion_id", "document_id")
    src = docs.select(F.col("assertion_id").alias("source_assertion_id"), F.col("document_id").alias("_d1"))
    tgt = docs.select(F.col("assertion_id").alias("target_assertion_id"), F.col("document_id").alias("_d2"))
    across = (found.join(src, "source_assertion_id", "left").join(tgt, "target_assertion_id", "left")
              .where(~F.col("_d1").eqNullSafe(F.col("_d2"))).drop("_d1", "_d2"))
    keyed = across.select("*", *pair_key(F.col("source_assertion_id"), F.col("target_assertion_id")))
    fresh = keyed.join(linked_pairs(relations), ["low_id", "high_id"], "left_anti")
    return top_per_key(fresh, ["low_id", "high_id"], order, 1).drop("low_id", "high_id")
