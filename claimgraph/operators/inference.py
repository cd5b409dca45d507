"""Backward proof of claims, set-oriented over all claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.operators import evidence as E
from claimgraph.operators import paths as P
from claimgraph.operators import retrieval as R
from claimgraph.session import cut_lineage, few

SEED_CHUNKS = 10


def claim_seeds(claims: DataFrame, vectors: DataFrame, assertions: DataFrame, top_chunks: int = SEED_CHUNKS) -> DataFrame:
    """Live assertions of a claim's best chunks, by confidence."""
    return R.condition_a_v1(R.top_chunks(claims, vectors, top_chunks), assertions)


def chains_in_season(chains: DataFrame, scopes: DataFrame, season: str) -> DataFrame:
    """Chains none of whose hops is scoped to another season.

    ``scopes`` is (source_assertion_id, target_assertion_id, relationship_id,
    temporal_season, temporal_is_default); the first relation of a hop counts.
    ``chains`` has a ``chain_id``.
    """
    hops = chains.select("chain_id", F.explode(F.arrays_zip(
        F.slice("chain", F.lit(1), F.size("chain") - 1).alias("s"), F.slice("chain", F.lit(2), F.size("chain") - 1).alias("t"))).alias("h"))
    first = scopes.groupBy("source_assertion_id", "target_assertion_id").agg(
        F.min_by(F.struct("temporal_season", "temporal_is_default"), "relationship_id").alias("scope"))
    other = (~F.coalesce("scope.temporal_is_default", F.lit(True)) & F.col("scope.temporal_season").isNotNull()
             & (F.lower("scope.temporal_season") != season.lower()))
    blocked = (hops.join(first, (F.col("h.s") == F.col("source_assertion_id")) & (F.col("h.t") == F.col("target_assertion_id")))
               .where(other).select("chain_id").distinct())
    return chains.join(blocked, "chain_id", "left_anti")


def chain_id() -> Column:
    """A key from claim, target and edges."""
    return F.concat_ws("|", F.col("query_id").cast("string"), F.col("target").cast("string"),
                       F.array_join(F.col("edge_ids").cast("array<string>"), ">"))


def proof_chains(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, max_depth: int = 4,
                 season: str | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """Chains that support a claim, in order: by seed, then by length, each seed's own row last.

    A seed with an active rebuttal supports nothing.
    """
    targets = few(seeds.select("query_id", F.col("assertion_id").alias("node")))
    beaten = (P.rebuttals(targets, edges, assertions, season).select("query_id", F.col("claim_id").alias("assertion_id"))
              .distinct())
    standing = few(seeds.join(beaten, ["query_id", "assertion_id"], "left_anti"))
    longer = P.backward_chains(standing.select("query_id", F.col("assertion_id").alias("node")), edges, assertions, max_depth)
    longer = longer.withColumn("chain_id", chain_id())
    if season is not None and scopes is not None:
        longer = chains_in_season(longer, scopes, season)
    longer = longer.withColumn("chain_confidence", P.chain_confidence(F.col("confs"), F.col("hops")))
    ranks = standing.select("query_id", F.col("assertion_id").alias("target"), F.col("rank").alias("seed_rank"), "claim_text",
                            F.col("confidence").alias("seed_confidence"))
    cols = ["query_id", "target", "chain_id", "chain", "rels", "confs", "hops", "edge_ids", "chain_confidence"]
    own = ranks.select("query_id", "target", F.concat_ws("|", F.col("query_id").cast("string"), F.col("target").cast("string")).alias("chain_id"),
                       F.array("target").alias("chain"), F.array().cast("array<string>").alias("rels"),
                       F.array("seed_confidence").alias("confs"), F.lit(0).alias("hops"),
                       F.array().cast("array<bigint>").alias("edge_ids"), F.col("seed_confidence").alias("chain_confidence"))
    both = longer.select(*cols).unionByName(own.select(*cols)).join(ranks.drop("seed_confidence"), ["query_id", "target"])
    kind = F.when(F.col("hops") == 0, "direct: ").otherwise("supports: ")
    return (both.withColumn("conclusion", F.concat(kind, F.substring("claim_text", 1, 100))).drop("claim_text")
            .withColumn("place", F.struct("seed_rank", (F.col("hops") == 0).alias("own"), "hops", "edge_ids")))


def consistency(chains: DataFrame, conflicts: DataFrame) -> DataFrame:
    """consistent or contradictory, from conflicts between any two assertions of a claim's chains."""
    ids = chains.select("query_id", F.explode("chain").alias("assertion_id")).distinct()
    clashes = E.table_contradictions(ids, conflicts).groupBy("query_id").agg(F.count("*").alias("n"))
    return (chains.select("query_id").distinct().join(clashes, "query_id", "left")
            .select("query_id", F.when(F.coalesce("n", F.lit(0)) > 0, "contradictory").otherwise("consistent")
                    .alias("consistency_status")))


def best_chains(chains: DataFrame) -> DataFrame:
    """The most confident chain of each claim, the earliest on a tie."""
    best = F.min_by(F.struct("chain", "chain_confidence"), F.struct((-F.col("chain_confidence")).alias("c"), F.col("place")))
    return chains.groupBy("query_id").agg(best.alias("b")).select("query_id", "b.chain", "b.chain_confidence")


def toulmin_completeness(chains: DataFrame, assertions: DataFrame) -> DataFrame:
    """Whether a claim's best chain has both a warrant and a ground."""
    ids = few(best_chains(chains).select("query_id", F.explode("chain").alias("assertion_id")).distinct())
    roles = (ids.join(assertions.select("assertion_id", "discourse_role"), "assertion_id")
             .groupBy("query_id").agg(F.coalesce(F.bool_or(F.col("discourse_role") == "warrant"), F.lit(False)).alias("w"),
                                      F.coalesce(F.bool_or(F.col("discourse_role") == "ground"), F.lit(False)).alias("g")))
    state = (F.when(F.col("w") & F.col("g"), "complete").when(F.col("w"), "missing_ground")
             .when(F.col("g"), "missing_warrant").otherwise("incomplete"))
    return roles.select("query_id", state.alias("toulmin_completeness"))


def first_chains(chains: DataFrame, limit: int = 20) -> DataFrame:
    return top_per_key(chains, ["query_id"], [F.col("place")], limit, rank="position")


def prove(claims: DataFrame, seeds: DataFrame, chains: DataFrame, edges: DataFrame, assertions: DataFrame,
          conflicts: DataFrame, season: str | None = None) -> DataFrame:
    """One verdict per claim: proven, conflicted or inconclusive."""
    best = best_chains(chains).select("query_id", F.col("chain_confidence").alias("confidence"))
    totals = chains.groupBy("query_id").agg(F.count("*").alias("n_chains"))
    contested = seeds.groupBy("query_id").agg(F.count_if(F.col("epistemic_status") == "contested").alias("contested_seeds"))
    defeated = (P.rebuttals(few(seeds.select("query_id", F.col("assertion_id").alias("node"))), edges, assertions, season)
                .groupBy("query_id").agg(F.countDistinct("claim_id").alias("defeated_seeds"), F.count("*").alias("active_rebuttals")))
    joined = claims.select("query_id")
    for part in (totals, best, consistency(chains, conflicts), toulmin_completeness(chains, assertions), contested, defeated):
        joined = joined.join(part, "query_id", "left")
    return joined.select(
        "query_id", F.when(F.col("n_chains").isNull(), "inconclusive")
        .when(F.col("consistency_status") == "contradictory", "conflicted").otherwise("proven").alias("conclusion"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("consistency_status", F.lit("incomplete")).alias("consistency_status"),
        F.coalesce("toulmin_completeness", F.lit("incomplete")).alias("toulmin_completeness"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_chains", "contested_seeds", "defeated_seeds", "active_rebuttals")])


def derived_assertions(claims: DataFrame, seeds: DataFrame, chains: DataFrame, limit: int = 3) -> DataFrame:
    """New assertions from a claim's first chains of two or more hops, unless a seed already says so."""
    first = top_per_key(chains.where("hops >= 2"), ["query_id"], [F.col("place")], limit)
    made = first.withColumn("claim_text", F.concat(F.lit("[Derived via "), F.array_join("rels", "-"), F.lit("] "), F.col("conclusion")))
    fresh = made.join(seeds.select("query_id", "claim_text"), ["query_id", "claim_text"], "left_anti")
    links = F.zip_with("chain", F.array_append("rels", F.lit("")),
                       lambda a, r: F.struct(a.alias("assertion_id"), r.alias("relation_type")))
    return (fresh.join(claims.select("query_id", "query_text"), "query_id")
            .select(F.sha2("chain_id", 256).alias("assertion_id"), F.lit(None).cast("bigint").alias("chunk_id"), "query_id",
                    "claim_text", F.lit("inference_engine").alias("subject"), F.lit("relates_to").alias("predicate_type"),
                    F.col("query_text").alias("object_text"), F.lit("inference_engine").alias("source_document"),
                    F.lit("derived").alias("epistemic_status"), F.col("chain_confidence").alias("confidence"),
                    F.lit("inference").alias("domain"), links.alias("derivation_chain")))
