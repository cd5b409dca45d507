"""Hop-bounded traversals over edge DataFrames.

Within one path an edge may not repeat while a node may, so paths carry their
edge ids.  Every operator takes a DataFrame of seeds; all hops are one lazy
chain of joins on one shuffled copy of the edges, and each hop is cut to the
paths that can still be in the answer.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.operators.assertions import live, positive_or
from claimgraph.operators.graph import SHOWN_TYPES
from claimgraph.session import cut_lineage, few

# Edge types of each traversal.
PROOF_TYPES = ["ENTAILS", "DEFINES", "TRIGGERS", "SPECIALIZES", "SUPERSEDES"]
TOULMIN_TYPES = ["ENTAILS", "CAUSES", "TRIGGERS", "SPECIALIZES"]
CAUSAL_CONTEXT_TYPES = ["CAUSES", "INHIBITS", "CORRELATES_WITH"]
CAUSAL_CHAIN_TYPES = ["CAUSES", "INHIBITS"]
DECAY = 0.9
# Paths that one task sorts, about.
PATHS_PER_TASK = 200_000


def live_ids(assertions: DataFrame) -> DataFrame:
    return assertions.where(live()).select("assertion_id")


def still_live(ends: DataFrame, assertions: DataFrame) -> DataFrame:
    """``ends`` (query_id, assertion_id) that are live; few ends are looked up where the assertions are read."""
    ends = few(ends)
    known = live_ids(assertions).join(ends.select("assertion_id"), "assertion_id", "left_semi")
    return ends.join(known, "assertion_id", "left_semi")


def of_types(edges: DataFrame, types: Sequence[str], truth_preserving: bool = False) -> DataFrame:
    kept = edges.where(F.col("type").isin(list(types)))
    return kept.where("is_truth_preserving") if truth_preserving else kept


def steps(edges: DataFrame, direction: str = "out") -> DataFrame:
    """Edges as (here, there, edge_id, type, confidence): along, against or both ways."""
    cols = ["edge_id", "type", "confidence"]
    if direction == "out":
        return edges.select(F.col("src").alias("here"), F.col("dst").alias("there"), *cols)
    if direction == "in":
        return edges.select(F.col("dst").alias("here"), F.col("src").alias("there"), *cols)
    # A self-loop is one step, not two.
    way = F.explode(F.when(F.col("src") == F.col("dst"), F.array(F.struct(F.col("src").alias("h"), F.col("dst").alias("t"))))
                    .otherwise(F.array(F.struct(F.col("src").alias("h"), F.col("dst").alias("t")),
                                       F.struct(F.col("dst").alias("h"), F.col("src").alias("t")))))
    return edges.select(way.alias("w"), *cols).select(F.col("w.h").alias("here"), F.col("w.t").alias("there"), *cols)


def first_steps(steps_df: DataFrame, order: Sequence[Column], paths: int, max_hops: int) -> DataFrame:
    """The steps of a node that any of its best ``paths`` extensions can use.

    For the best ``paths`` of each seed, a path is extended by at most that many
    steps; it may have to skip the fewer than ``max_hops`` edges it already holds.
    A hub is cut to this number of edges before it meets a path.
    """
    return top_per_key(steps_df, ["here"], order, paths + max_hops)


def _unmatched(node: Column, is_text: bool) -> Column:
    """A join key that no edge has, different per node so that it spreads."""
    return F.concat(F.lit("-"), node) if is_text else -1 - node


def walk(seeds: DataFrame, keys: Sequence[str], steps_df: DataFrame, max_hops: int,
         keep: Callable[[DataFrame], DataFrame] = lambda paths: paths) -> DataFrame:
    """Paths of 1 to ``max_hops`` steps from ``seeds`` (keys..., node).

    Each hop lets a path stay as it is and also go on; ``keep`` cuts the paths
    after each hop.  Staying rows join on keys that match nothing, so the chain
    has one join per hop instead of one per hop and shorter path.
    """
    is_text = dict(steps_df.dtypes)["here"] == "string"
    start = seeds.select(*keys, F.col("node").alias("start"), "node")
    first = start.join(steps_df, start.node == steps_df.here).select(
        *keys, "start", F.col("there").alias("node"), F.array("start", "there").alias("nodes"),
        F.array("edge_id").alias("edge_ids"), F.array("type").alias("types"),
        F.array("confidence").alias("confidences"),
        (positive_or(F.col("confidence")) * DECAY).alias("chain_confidence"), F.lit(1).alias("hops"))
    paths = keep(first)
    for hop in range(2, max_hops + 1):
        moves = paths.withColumn("go", F.explode(F.when(
            F.col("hops") == hop - 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
        moves = moves.withColumn("key", F.when(F.col("go"), F.col("node")).otherwise(_unmatched(F.col("node"), is_text)))
        joined = moves.join(steps_df, moves.key == steps_df.here, "left").where(
            ~F.col("go") | (F.col("here").isNotNull() & ~F.array_contains("edge_ids", F.col("edge_id"))))

        def grown(longer: Column, name: str) -> Column:
            return F.when(F.col("go"), longer).otherwise(F.col(name)).alias(name)

        paths = keep(joined.select(
            *keys, "start", grown(F.col("there"), "node"), grown(F.array_append("nodes", F.col("there")), "nodes"),
            grown(F.array_append("edge_ids", F.col("edge_id")), "edge_ids"),
            grown(F.array_append("types", F.col("type")), "types"),
            grown(F.array_append("confidences", F.col("confidence")), "confidences"),
            grown(F.col("chain_confidence") * positive_or(F.col("confidence")) * DECAY, "chain_confidence"),
            F.when(F.col("go"), hop).otherwise(F.col("hops")).alias("hops")))
    return paths


def chain_confidence(confidences: Column, hops: Column) -> Column:
    """Product of the confidences times the decay per hop; no confidences give 0."""
    product = F.aggregate(confidences, F.lit(1.0), lambda a, x: a * x)
    return F.when(F.size(confidences) == 0, F.lit(0.0)).otherwise(product * F.pow(F.lit(DECAY), hops))


def forward_trace(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, max_hops: int = 3,
                  per_seed: int = 10) -> DataFrame:
    """Best truth-preserving chains that leave a seed through live nodes.

    ``seeds`` is (query_id, node).  A step always lowers the confidence, so a
    chain among the best ten has all its prefixes among the best ten and ten
    paths per seed are enough at every hop.
    """
    alive = live_ids(assertions)
    usable = of_types(edges, PROOF_TYPES, True).join(alive, F.col("dst") == F.col("assertion_id"), "left_semi")
    started = seeds.join(alive, F.col("node") == F.col("assertion_id"), "left_semi")
    order = [F.desc("chain_confidence"), F.col("hops"), F.col("edge_ids")]
    usable_steps = first_steps(steps(usable), [F.desc(positive_or(F.col("confidence"))), F.col("edge_id")], per_seed, max_hops)
    best = walk(started, ["query_id"], usable_steps, max_hops,
                lambda p: top_per_key(p, ["query_id", "start"], order, per_seed))
    return best.withColumn("relation_used", F.element_at("types", -1))


def backward_chains(targets: DataFrame, edges: DataFrame, assertions: DataFrame, max_depth: int = 4,
                    per_target: int = 20) -> DataFrame:
    """Chains of live nodes that end in a target, shortest first.

    A longer chain always ranks after its own tail, so twenty paths per target
    are enough at every hop.  Arrays run from the chain's first node to the target.
    """
    alive = live_ids(assertions)
    usable = of_types(edges, PROOF_TYPES, True).join(alive, F.col("src") == F.col("assertion_id"), "left_semi")
    started = targets.join(alive, F.col("node") == F.col("assertion_id"), "left_semi")
    order = [F.col("hops"), F.col("edge_ids")]
    usable_steps = first_steps(steps(usable, "in"), [F.col("edge_id")], per_target, max_depth)
    found = walk(started, ["query_id"], usable_steps, max_depth,
                 lambda p: top_per_key(p, ["query_id", "start"], order, per_target))
    confidences = F.transform(F.reverse("confidences"), lambda c: F.coalesce(c, F.lit(0.8)))
    return found.select("query_id", F.col("start").alias("target"), F.reverse("nodes").alias("chain"),
                        F.reverse("types").alias("rels"), confidences.alias("confs"), "hops",
                        F.reverse("edge_ids").alias("edge_ids"))


def causal_context(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, per_seed: int = 5) -> DataFrame:
    """One-hop causes and correlations of a seed with live targets."""
    kept = of_types(edges, CAUSAL_CONTEXT_TYPES)
    hits = (seeds.join(kept, F.col("node") == F.col("src"))
            .join(live_ids(assertions), F.col("dst") == F.col("assertion_id"), "left_semi"))
    return (top_per_key(hits, ["query_id", "node"], [F.col("edge_id")], per_seed)
            .select("query_id", F.col("node").alias("seed"), F.col("dst").alias("target"), "type", "mechanism",
                    "strength", "edge_id"))


def reachable(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, types: Sequence[str],
              direction: str, max_hops: int = 2, truth_preserving: bool = False) -> DataFrame:
    """Distinct live ends within ``max_hops``; nodes on the way may be dead.

    A path uses an edge once.  For two hops it does not matter which path led to the
    middle but for its edge, and of two different first edges one differs from any second
    edge: two of them per query and middle are kept, so a hub is left along each of its
    edges twice at most, however many edges lead to it.
    """
    ways = steps(of_types(edges, types, truth_preserving), direction)
    if max_hops == 2:
        start = seeds.select("query_id", "node").distinct()
        first = start.join(ways, start.node == ways.here).select("query_id", F.col("there").alias("middle"), "edge_id").distinct()
        two = few(top_per_key(first, ["query_id", "middle"], [F.col("edge_id")], 2).withColumnRenamed("edge_id", "first_edge"))
        second = two.join(ways, two.middle == ways.here).where("edge_id <> first_edge").select("query_id", F.col("there").alias("node"))
        paths = first.select("query_id", F.col("middle").alias("node")).unionByName(second)
    else:
        paths = walk(seeds, ["query_id"], ways, max_hops)
    ends = paths.select("query_id", F.col("node").alias("assertion_id")).distinct()
    return still_live(ends, assertions)


def toulmin_neighborhood(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, directed: bool = False) -> DataFrame:
    return reachable(seeds, edges, assertions, TOULMIN_TYPES, "out" if directed else "both")


def toulmin_expansion(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, variant: str = "v4",
                      n_seeds: int = 5, limit: int = 100) -> DataFrame:
    """Ends of directed truth-preserving paths from the first seeds of a query.

    ``variant`` v1 and v2 walk the proof types, v4 the argument types.  ``seeds``
    is (query_id, node, rank); the kept ends are the smallest ids.
    """
    types = TOULMIN_TYPES if variant == "v4" else PROOF_TYPES
    found = reachable(seeds.where(F.col("rank") <= n_seeds), edges, assertions, types, "out", 2, True)
    return top_per_key(found, ["query_id"], [F.col("assertion_id")], limit)


def generic_expansion(seeds: DataFrame, edges: DataFrame, assertions: DataFrame, n_seeds: int = 10,
                      limit: int = 200) -> DataFrame:
    """Live neighbours over any edge in either direction."""
    near = seeds.where(F.col("rank") <= n_seeds).join(steps(edges, "both"), F.col("node") == F.col("here"))
    ends = still_live(near.select("query_id", F.col("there").alias("assertion_id")).distinct(), assertions)
    return top_per_key(ends, ["query_id"], [F.col("assertion_id")], limit)


def neighborhood_paths(centres: DataFrame, all_edges: DataFrame, depth: int = 2, limit: int = 100) -> DataFrame:
    """The first ``limit`` undirected paths around a centre, shortest first, over every label.

    As shorter paths rank first, a centre that has its paths together stops
    there; a hub is never expanded beyond the limit.  Paths are wide rows and scattered over
    the tasks that join them, where a cut per centre finds little to drop: they are dealt out
    by centre before they are sorted, to as many tasks as the centres need.
    """
    order = [F.col("hops"), F.col("edge_ids")]
    tasks = max(centres.sparkSession.sparkContext.defaultParallelism, math.ceil(centres.count() * limit / PATHS_PER_TASK))
    edges = all_edges if "confidence" in all_edges.columns else all_edges.withColumn("confidence", F.lit(None).cast("double"))
    depth = min(depth, 4)
    return walk(centres, ["query_id"], first_steps(steps(edges, "both"), [F.col("edge_id")], limit, depth), depth,
                lambda p: top_per_key(p.repartition(tasks, "query_id", "start"), ["query_id", "start"], order, limit))


def neighborhood_nodes(paths: DataFrame) -> DataFrame:
    return paths.select("query_id", F.explode("nodes").alias("node")).distinct()


def neighborhood_edges(paths: DataFrame) -> DataFrame:
    return paths.select("query_id", F.explode("edge_ids").alias("edge_id")).distinct()


def assertion_view(assertions: DataFrame, edges: DataFrame) -> DataFrame:
    """Assertions with their outgoing logical edges, one row per edge; one row where there is none."""
    shown = of_types(edges, SHOWN_TYPES).select(
        F.col("src").alias("assertion_id"), F.col("type").alias("relation_type"), F.col("dst").alias("target_assertion_id"),
        F.coalesce("is_truth_preserving", F.lit(False)).alias("is_truth_preserving"),
        F.coalesce("is_defeasible", F.lit(False)).alias("is_defeasible"), "evidence_text", "mechanism", "strength",
        positive_or(F.col("confidence")).alias("edge_confidence"))
    return (assertions.select("assertion_id", "subject", "source_document", "epistemic_status", "confidence", "domain")
            .join(shown, "assertion_id", "left"))


def representatives(paths: DataFrame, keys: Sequence[str], hops: int, left: int, best: int) -> DataFrame:
    """Trails of ``hops`` edges that stand for all trails with the same ``keys``.

    Whatever ``left`` edges a trail may still take, those of its group that do not hold them already keep
    their ``best`` smallest edge lists.  Let trails of a group agree on all but f positions.  If no edge at
    one of those holds more than N(f - 1) of them, the edges to come rule out at most left * f * N(f - 1), so
    N(f) = best + left * f * N(f - 1) of them are enough; with no free position a trail is alone, N(0) = 1.
    The caps go from the most agreed positions to none, so a group is a bounded number of rows.
    """
    cap = 1
    for free in range(1, hops + 1):
        cap = best + left * free * cap
        for agreed in combinations(range(1, hops + 1), hops - free):
            own = [F.element_at("edge_ids", at) for at in agreed]
            place = F.row_number().over(Window.partitionBy(*keys, *own).orderBy("edge_ids"))
            paths = paths.withColumn("place", place).where(F.col("place") <= cap).drop("place")
    return paths


def causal_chains(pairs: DataFrame, concept_edges: DataFrame, edges: DataFrame, max_hops: int = 3,
                  per_pair: int = 5) -> DataFrame:
    """Causal paths between assertions of two concepts, the first ``per_pair`` of a pair by (hops, edge_ids).

    ``pairs`` is (pair_id, source_concept, target_concept).  A first pass from the targets finds which
    nodes can still arrive in the hops left.  The forward pass keeps, for each pair and node, the
    ``representatives`` of the trails that reach it, so an edge is taken a bounded number of times per
    pair and hop, however many paths a hub has.  A pair that has its chains goes no further.
    """
    max_hops = min(max_hops, 4)
    kept = cut_lineage(of_types(edges, CAUSAL_CHAIN_TYPES).select("src", "dst", "edge_id", "type", "confidence"))
    pairs = cut_lineage(pairs.select("pair_id", "source_concept", "target_concept"))
    forward = steps(kept)
    anchors = lambda column: (pairs.join(concept_edges, F.col(column) == F.col("name"))
                              .select("pair_id", F.col("assertion_id").alias("node")).distinct())
    sources, targets = anchors("source_concept"), cut_lineage(anchors("target_concept"))
    backward = steps(kept, "in").select("here", "there")
    # (pair, node, left): node arrives in exactly ``left`` further steps.
    level = targets
    arrive = level.withColumn("left", F.lit(0))
    for left in range(1, max_hops + 1):
        level = cut_lineage(level.join(backward, F.col("node") == F.col("here"))
                            .select("pair_id", F.col("there").alias("node")).distinct())
        arrive = arrive.unionByName(level.withColumn("left", F.lit(left)))
    nearest = cut_lineage(arrive.groupBy("pair_id", "node").agg(F.min("left").alias("least_left")))

    order = [F.col("hops"), F.col("edge_ids")]
    trails = sources.select("pair_id", F.col("node").alias("start"), "node", F.array("node").alias("nodes"), *[
        F.array().cast(kind).alias(name) for name, kind in (("edge_ids", f"array<{dict(kept.dtypes)['edge_id']}>"),
                                                            ("types", "array<string>"), ("confidences", "array<double>"))],
        F.lit(1.0).alias("chain_confidence"))
    found = None
    for hop in range(1, max_hops + 1):
        longer = (trails.join(forward, trails.node == forward.here).where(~F.array_contains("edge_ids", F.col("edge_id")))
                  .select("pair_id", "start", F.col("there").alias("node"), F.array_append("nodes", F.col("there")).alias("nodes"),
                          F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"), F.array_append("types", F.col("type")).alias("types"),
                          F.array_append("confidences", F.col("confidence")).alias("confidences"),
                          (F.col("chain_confidence") * positive_or(F.col("confidence")) * DECAY).alias("chain_confidence")))
        able = longer.join(nearest, ["pair_id", "node"]).where(F.col("least_left") <= max_hops - hop).drop("least_left")
        if hop < max_hops:
            able = cut_lineage(representatives(able, ["pair_id", "node"], hop, max_hops - hop, per_pair))
        ended = able.join(targets, ["pair_id", "node"], "left_semi").withColumn("hops", F.lit(hop))
        ended = top_per_key(ended, ["pair_id"], order, per_pair)
        found = ended if found is None else found.unionByName(ended)
        if hop < max_hops:
            found = cut_lineage(found)
            full = found.groupBy("pair_id").count().where(F.col("count") >= per_pair)
            trails = able.join(full, "pair_id", "left_anti")
    return top_per_key(found, ["pair_id"], order, per_pair)


def rebuttals(claims: DataFrame, edges: DataFrame, assertions: DataFrame, season: str | None = None) -> DataFrame:
    """Live assertions that rebut a claim; a scope of another season is inactive."""
    against = few(claims.join(edges.where("type = 'REBUTS'").select("src", "dst"), F.col("node") == F.col("dst"))
                  .select("query_id", "node", F.col("src").alias("rebuttal_id")))
    scopes = assertions.where(live()).select(F.col("assertion_id").alias("rebuttal_id"), "temporal_season",
                                             "temporal_is_default")
    found = against.join(scopes, "rebuttal_id")
    if season is not None:
        other = (~F.col("temporal_is_default") & F.col("temporal_season").isNotNull()
                 & (F.lower("temporal_season") != season.lower()))
        found = found.where(~other)
    return found.select("query_id", F.col("node").alias("claim_id"), "rebuttal_id").distinct()


def outgoing_rebuttals(anchors: DataFrame, edges: DataFrame, assertions: DataFrame, limit: int = 10) -> DataFrame:
    """What an anchor rebuts, live only."""
    found = (anchors.join(edges.where("type = 'REBUTS'"), F.col("node") == F.col("src"))
             .join(live_ids(assertions), F.col("dst") == F.col("assertion_id"), "left_semi")
             .select("query_id", F.col("node").alias("anchor_id"), F.col("dst").alias("assertion_id"), "edge_id"))
    return top_per_key(found, ["query_id", "anchor_id"], [F.col("edge_id")], limit)
