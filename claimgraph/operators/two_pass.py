"""Two-pass retrieval and the evidence set of a question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import running, top_per_key
from claimgraph.operators import evidence as E
from claimgraph.operators import paths as P
from claimgraph.operators import retrieval as R
from claimgraph.session import cut_lineage, few


def two_pass(found: DataFrame, assertions: DataFrame, edges: DataFrame, citations: DataFrame,
             k: int = R.MAX_K) -> DataFrame:
    """All rows of a two-pass retrieval: (query_id, position, layer, assertion_id, ...).

    Pass one is the gated search with the first peripheral rows of its regulation
    (``pass1_rank``, ``obligation_position``).  Pass two widens its first row, the
    anchor, without a type filter and sorts everything into layers.
    """
    pass1 = few(R.condition_c(found, assertions, k))
    anchor = pass1.where("rank = 1").select("query_id", F.col("assertion_id").alias("node"))
    periphery = cut_lineage(E.regulation_periphery(pass1.where("rank <= 5"), citations, assertions))
    none = F.lit(None).cast("bigint")

    def rows(df: DataFrame, source: int, key: Column, obligation: Column, pass1_rank: Column = none) -> DataFrame:
        return df.select("query_id", "assertion_id", F.struct(F.lit(source).alias("s"), key.cast("bigint").alias("k")).alias("o"),
                         obligation.cast("bigint").alias("obligation"), pass1_rank.cast("bigint").alias("pass1_rank"))

    position = F.col("position")
    candidates = (
        rows(P.toulmin_neighborhood(anchor, edges, assertions), 0, F.col("assertion_id"), none)
        .unionByName(rows(periphery.where("position <= 10"), 1, position, F.when(position <= 5, k + position)))
        .unionByName(rows(pass1, 2, F.col("rank"), F.col("rank"), F.col("rank"))))
    merged = R.fetch(candidates.groupBy("query_id", "assertion_id").agg(
        F.min("o").alias("o"), F.min("obligation").alias("obligation"), F.min("pass1_rank").alias("pass1_rank")), assertions)
    layer = (F.when((F.col("validity_claim_type") == "normative") | (F.col("discourse_role") == "warrant"), "warrant")
             .when(F.col("discourse_role") == "backing", "backing").otherwise("ground"))
    merged = cut_lineage(merged.withColumn("layer", layer))
    against = P.outgoing_rebuttals(anchor, edges, assertions)
    against = (rows(against, 0, F.col("edge_id"), none).groupBy("query_id", "assertion_id")
               .agg(F.min("o").alias("o"), F.min("obligation").alias("obligation"), F.min("pass1_rank").alias("pass1_rank"))
               .join(merged.select("query_id", "assertion_id"), ["query_id", "assertion_id"], "left_anti"))
    everything = merged.unionByName(R.fetch(against, assertions).withColumn("layer", F.lit("rebuttal")))
    order_of_layer = (F.when(F.col("obligation").isNotNull(), 0).when(F.col("layer") == "warrant", 1)
                      .when(F.col("layer") == "ground", 2).when(F.col("layer") == "backing", 3).otherwise(4))
    place = F.when(F.col("obligation").isNotNull(), F.struct(F.lit(0).alias("s"), F.col("obligation").alias("k"))).otherwise(F.col("o"))
    ordered = everything.withColumn("section", order_of_layer).withColumn("place", place)
    bucket = F.struct(F.col("section"), F.col("place.s"), F.floor(F.col("place.k") / 65_536))
    return (running(ordered, ["query_id"], [F.col("section"), F.col("place")], bucket, {"position": F.lit(1)})
            .select("query_id", "position", "layer", "assertion_id", "pass1_rank",
                    F.col("obligation").alias("obligation_position"), F.col("o").alias("layer_place"),
                    (F.col("o.s") == 0).alias("is_neighbour"), *R.FIELDS))


def two_pass_summary(rows: DataFrame, queries: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per query: anchor, the four context texts, sizes, conflicts and the completeness warning."""
    in_layer = lambda name: F.col("layer") == name
    first = lambda value, order, cond: F.min_by(value, F.when(cond, order))
    neighbour = F.col("is_neighbour") & ~in_layer("rebuttal")
    per_query = rows.groupBy("query_id").agg(
        first("assertion_id", F.col("pass1_rank"), F.col("pass1_rank").isNotNull()).alias("anchor_assertion_id"),
        first("claim_text", F.col("obligation_position"), F.col("obligation_position").isNotNull()
              & (F.col("validity_claim_type") == "normative")).alias("obligation"),
        first("claim_text", F.col("layer_place"), in_layer("ground") & (F.col("validity_claim_type") == "constative"))
        .alias("factual_predicate"),
        first("claim_text", F.col("pass1_rank"), F.col("pass1_rank").isNotNull()).alias("inference_warrant"),
        first("claim_text", F.col("layer_place"), in_layer("rebuttal")).alias("exemption_conditions"),
        F.count("pass1_rank").alias("pass_1_retrieved"), F.count("*").alias("total_retrieved"),
        F.count_if(neighbour).alias("neighborhood_size"))
    # min_by returns a row even where no row qualifies; its order value tells.
    checks = rows.groupBy("query_id").agg(
        F.bool_or(F.col("obligation_position").isNotNull() & (F.col("validity_claim_type") == "normative")).alias("_o"),
        F.bool_or(in_layer("ground") & (F.col("validity_claim_type") == "constative")).alias("_f"),
        F.bool_or(in_layer("rebuttal")).alias("_r"))
    sources = (rows.where(~in_layer("rebuttal") & (F.coalesce("source_document", F.lit("")) != ""))
               .select("query_id", "source_document").distinct().groupBy("query_id")
               .agg(F.count("*").alias("n_sources")))
    pairs = E.graph_contradictions(rows, edges).groupBy("query_id").agg(F.count("*").alias("conflict_pairs"))

    def text(name: str, flag: str | None = None) -> Column:
        value = F.col(name) if flag is None else F.when(F.col(flag), F.col(name))
        return F.coalesce(value, F.lit("")).alias(name)

    return (queries.select("query_id").join(per_query, "query_id", "left").join(checks, "query_id", "left")
            .join(sources, "query_id", "left").join(pairs, "query_id", "left")
            .select("query_id", "anchor_assertion_id", text("obligation", "_o"), text("factual_predicate", "_f"),
                    text("inference_warrant"), text("exemption_conditions", "_r"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in (
                        "pass_1_retrieved", "total_retrieved", "neighborhood_size", "n_sources", "conflict_pairs")])
            .withColumn("conflict_detected", F.col("conflict_pairs") > 0)
            .withColumn("completeness_warning", F.col("neighborhood_size") == 0))


def question_sources(chunks: DataFrame, assertions: DataFrame, min_confidence: float = 0.5,
                     include_contested: bool = True, include_derived: bool = True) -> DataFrame:
    """Live assertions of a question's best chunks, in order of chunk and id."""
    kept = assertions.where(F.col("confidence") >= min_confidence)
    for wanted, status in [(include_contested, "contested"), (include_derived, "derived")]:
        if not wanted:
            kept = kept.where(~F.col("epistemic_status").eqNullSafe(F.lit(status)))
    rows = chunks.select("query_id", F.col("rank").alias("chunk_rank"), "chunk_id").join(
        kept.select("chunk_id", "assertion_id"), "chunk_id")
    fetched = R.fetch(rows, assertions)
    bucket = F.struct(F.col("chunk_rank"), F.floor(F.col("assertion_id") / 65_536))
    return running(fetched, ["query_id"], [F.col("chunk_rank"), F.col("assertion_id")], bucket, {"rank": F.lit(1)})


def answer_evidence(chunks: DataFrame, queries: DataFrame, assertions: DataFrame, edges: DataFrame, conflicts: DataFrame,
                    citations: DataFrame, max_hops: int = 3, **options) -> DataFrame:
    """Everything a question's answer rests on, one nested row per question.

    Arrays are cut before they are collected: 10 sources, 20 trace steps, 10
    causal links and at most 15 context rows.
    """
    include_derived = options.get("include_derived", True)
    sources = cut_lineage(question_sources(chunks, assertions, **options))
    seeds = sources.where("rank <= 5").select("query_id", F.col("assertion_id").alias("node"), "rank")
    order = seeds.withColumnRenamed("node", "start")
    trace = P.forward_trace(seeds.select("query_id", "node"), edges, assertions, max_hops)
    trace = R.fetch(trace.withColumnRenamed("node", "assertion_id"), assertions).join(order, ["query_id", "start"])
    if not include_derived:
        trace = trace.where(~F.col("epistemic_status").eqNullSafe(F.lit("derived")))
    trace = top_per_key(trace, ["query_id"], [F.col("rank"), F.desc("chain_confidence"), F.col("hops"), F.col("edge_ids")], 20, rank="p")
    causal = (P.causal_context(seeds.select("query_id", "node"), edges, assertions)
              .join(order.withColumnRenamed("start", "seed"), ["query_id", "seed"]))
    causal = top_per_key(causal, ["query_id"], [F.col("rank"), F.col("edge_id")], 10, rank="p")
    context = E.regulation_context(sources, citations, assertions)
    clashes = E.table_contradictions(sources, conflicts).groupBy("query_id").agg(F.count("*").alias("contradictions"))
    counts = sources.groupBy("query_id").agg(F.count("*").alias("n_assertions"),
                                             F.count_if(F.col("epistemic_status") == "contested").alias("n_contested"))

    def listed(rows: DataFrame, fields: list[str], name: str) -> DataFrame:
        return rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))

    return (queries.select("query_id").join(counts, "query_id", "left").join(clashes, "query_id", "left")
            .join(listed(sources.where("rank <= 10"), ["rank", "assertion_id", "confidence", "epistemic_status"], "sources"), "query_id", "left")
            .join(listed(trace, ["p", "assertion_id", "relation_used", "hops", "chain_confidence"], "reasoning_trace"), "query_id", "left")
            .join(listed(causal, ["p", "target", "type", "mechanism", "strength"], "causal_context"), "query_id", "left")
            .join(listed(context, ["regulation", "layer", "position", "assertion_id"], "regulation_context"), "query_id", "left")
            .fillna({"n_assertions": 0, "n_contested": 0, "contradictions": 0})
            .withColumn("consistency_status", F.when(F.col("contradictions") > 0, "contradictory").otherwise("consistent")))
