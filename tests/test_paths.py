import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph import schemas as S
from claimgraph.operators import inference as I
from claimgraph.operators import paths as P

EDGE = "src bigint, dst bigint, type string, edge_id bigint, confidence double, is_truth_preserving boolean, mechanism string, strength string"


def edges(spark, rows):
    """Rows (src, dst, type, confidence)."""
    return spark.createDataFrame([(s, d, t, i, c, t in S.TRUTH_PRESERVING, "", "") for i, (s, d, t, c) in enumerate(rows)], EDGE)


def claims(spark, n, dead=(), seasons=None):
    rows = [(i, "deprecated" if i in dead else "authoritative", (seasons or {}).get(i), i not in (seasons or {})) for i in range(n)]
    return spark.createDataFrame(rows, "assertion_id bigint, epistemic_status string, temporal_season string, temporal_is_default boolean")


def seeds(spark, *nodes):
    return spark.createDataFrame([(1, n, i + 1) for i, n in enumerate(nodes)], "query_id bigint, node bigint, rank int")


def ends(df):
    return sorted(r.assertion_id for r in df.collect())


def test_backward_chain(spark):
    e = edges(spark, [(0, 1, "ENTAILS", 0.9), (1, 2, "ENTAILS", 0.9)])
    rows = P.backward_chains(seeds(spark, 2), e, claims(spark, 3)).orderBy("hops").collect()
    assert [(r.chain, r.rels, r.confs) for r in rows] == [([1, 2], ["ENTAILS"], [0.9]), ([0, 1, 2], ["ENTAILS"] * 2, [0.9, 0.9])]


@pytest.mark.parametrize("confs,want", [([0.9] * 3, 0.531441), ([0.9, 0.8], 0.5832), ([0.9] * 4, 0.43046721), ([], 0.0)])
def test_chain_confidence(spark, confs, want):
    df = spark.createDataFrame([(confs, len(confs))], "c array<double>, h int")
    assert df.select(P.chain_confidence(F.col("c"), F.col("h")).alias("v")).first().v == pytest.approx(want)


def test_parallel_edges_lead_back_to_the_start(spark):
    two = edges(spark, [(0, 1, "ENTAILS", 0.9), (0, 1, "CAUSES", 0.9)])
    assert ends(P.toulmin_neighborhood(seeds(spark, 0), two, claims(spark, 2))) == [0, 1]
    one = edges(spark, [(0, 1, "ENTAILS", 0.9)])
    assert ends(P.toulmin_neighborhood(seeds(spark, 0), one, claims(spark, 2))) == [1]


def test_dead_middle_node(spark):
    e, c = edges(spark, [(0, 1, "ENTAILS", 0.9), (1, 2, "ENTAILS", 0.9)]), claims(spark, 3, dead=[1])
    assert P.forward_trace(seeds(spark, 0), e, c).count() == 0
    assert P.backward_chains(seeds(spark, 2), e, c).count() == 0
    assert ends(P.toulmin_neighborhood(seeds(spark, 0), e, c)) == [2]
    assert ends(P.toulmin_neighborhood(seeds(spark, 0), e, c, directed=True)) == [2]


def test_causes_drops_out_of_truth_preserving_expansion(spark):
    e = edges(spark, [(0, 1, "CAUSES", 0.9), (0, 2, "TRIGGERS", 0.9), (0, 3, "DEFINES", 0.9)])
    assert ends(P.toulmin_expansion(seeds(spark, 0), e, claims(spark, 4), "v4")) == [2]
    assert ends(P.toulmin_expansion(seeds(spark, 0), e, claims(spark, 4), "v2")) == [2, 3]


def test_only_the_first_seeds_expand(spark):
    e = edges(spark, [(i, 10 + i, "ENTAILS", 0.9) for i in range(8)])
    assert ends(P.toulmin_expansion(seeds(spark, *range(8)), e, claims(spark, 20), "v2")) == list(range(10, 15))


def test_seasonal_rebuttal(spark):
    e = edges(spark, [(0, 1, "REBUTS", 0.9), (2, 1, "REBUTS", 0.9), (3, 1, "REBUTS", 0.9)])
    c = claims(spark, 4, dead=[3], seasons={0: "winter"})
    found = lambda season: sorted(r.rebuttal_id for r in P.rebuttals(seeds(spark, 1), e, c, season).collect())
    assert found("Winter") == [0, 2] and found("summer") == [2] and found(None) == [0, 2]
    assert [r.assertion_id for r in P.outgoing_rebuttals(seeds(spark, 0), e, c).collect()] == [1]


def trails(rows, start, max_hops, both=False):
    """All paths that repeat no edge, as (hops, edge ids, nodes)."""
    out, frontier = [], [((), (start,))]
    for _ in range(max_hops):
        grown = []
        for ids, nodes in frontier:
            for i, (s, d, _, _) in enumerate(rows):
                for here, there in {(s, d), (d, s)} if both else {(s, d)}:
                    if here == nodes[-1] and i not in ids:
                        grown.append((ids + (i,), nodes + (there,)))
        out += [(len(i), i, n) for i, n in grown]
        frontier = grown
    return out


edge_lists = st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.just("ENTAILS"), st.sampled_from([0.5, 0.7, 0.9])), min_size=1, max_size=9)


@settings(max_examples=12, deadline=None)
@given(rows=edge_lists)
def test_bounded_walks_equal_the_best_of_all_paths(spark, rows):
    e, c = edges(spark, rows), claims(spark, 6)

    def product(ids):
        value = 1.0
        for i in ids:
            value = value * rows[i][3] * 0.9
        return value

    for start in (0, 3):
        want = sorted((-product(i), h, i) for h, i, _ in trails(rows, start, 3))[:2]
        got = P.forward_trace(seeds(spark, start), e, c, 3, per_seed=2).collect()
        assert sorted((-r.chain_confidence, r.hops, tuple(r.edge_ids)) for r in got) == want
    pairs = e.select(F.concat(F.lit("A:"), F.col("src").cast("string")).alias("src"), F.concat(F.lit("A:"), F.col("dst").cast("string")).alias("dst"),
                     "type", F.lpad(F.col("edge_id").cast("string"), 3, "0").alias("edge_id"))
    centre = spark.createDataFrame([(1, "A:0")], "query_id bigint, node string")
    want = sorted((h, i) for h, i, _ in trails(rows, 0, 3, both=True))[:4]
    got = P.neighborhood_paths(centre, pairs, depth=3, limit=4).collect()
    assert sorted((r.hops, tuple(int(x) for x in r.edge_ids)) for r in got) == want


@settings(max_examples=8, deadline=None)
@given(rows=edge_lists)
def test_one_hop_neighbourhood_is_symmetric(spark, rows):
    found = P.reachable(spark.createDataFrame([(n, n) for n in range(6)], "query_id bigint, node bigint"), edges(spark, rows), claims(spark, 6),
                        ["ENTAILS"], "both", 1)
    pairs = {(r.query_id, r.assertion_id) for r in found.collect()}
    assert pairs == {(b, a) for a, b in pairs}


@settings(max_examples=8, deadline=None)
@given(rows=edge_lists)
def test_two_hops_reach_what_all_paths_reach(spark, rows):
    start = spark.createDataFrame([(1, 0), (1, 3), (2, 3)], "query_id bigint, node bigint")
    for direction in ("out", "both"):
        found = P.reachable(start, edges(spark, rows), claims(spark, 6), ["ENTAILS"], direction, 2)
        want = {(q, nodes[-1]) for q, n in ((1, 0), (1, 3), (2, 3)) for _, _, nodes in trails(rows, n, 2, direction == "both")}
        assert {(r.query_id, r.assertion_id) for r in found.collect()} == want


def test_a_hub_is_left_along_each_edge_twice_at_most(spark):
    n = 100_000
    star = spark.range(1, n + 1).selectExpr("0L as src", "id as dst", "'SUPPORTS' as type", "id as edge_id", "0.5D as confidence",
                                            "false as is_truth_preserving")
    alive = spark.range(n + 1).selectExpr("id as assertion_id", "'authoritative' as epistemic_status")
    leaves = spark.range(1, 2000).selectExpr("1L as query_id", "id as node")
    assert P.reachable(leaves, star, alive, ["SUPPORTS"], "both", 2).count() == n + 1


@settings(max_examples=8, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.integers(0, 5), st.just("CAUSES"), st.just(0.9)), min_size=1, max_size=8))
def test_causal_chains_equal_all_paths(spark, rows):
    names = spark.createDataFrame([(0, "x"), (1, "x"), (4, "y"), (5, "y")], "assertion_id bigint, name string")
    pairs = spark.createDataFrame([("p", "x", "y")], "pair_id string, source_concept string, target_concept string")
    got = P.causal_chains(pairs, names, edges(spark, rows), 3, per_pair=3).collect()
    want = sorted((h, i) for start in (0, 1) for h, i, n in trails(rows, start, 3) if n[-1] in (4, 5))[:3]
    assert sorted((r.hops, tuple(r.edge_ids)) for r in got) == want


@settings(max_examples=12, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 3), st.integers(0, 3), st.just("CAUSES"), st.just(0.9)), min_size=4, max_size=13),
       hops=st.integers(2, 4), best=st.integers(1, 3))
def test_causal_chains_of_crowded_graphs_equal_all_paths(spark, rows, hops, best):
    names = spark.createDataFrame([(0, "x"), (1, "x"), (1, "y"), (2, "y")], "assertion_id bigint, name string")
    pairs = spark.createDataFrame([("p", "x", "y"), ("q", "y", "x")], "pair_id string, source_concept string, target_concept string")
    got = P.causal_chains(pairs, names, edges(spark, rows), hops, per_pair=best).collect()
    for pair, starts, ends in (("p", (0, 1), (1, 2)), ("q", (1, 2), (0, 1))):
        want = sorted((h, i) for start in starts for h, i, n in trails(rows, start, hops) if n[-1] in ends)[:best]
        assert sorted((r.hops, tuple(r.edge_ids)) for r in got if r.pair_id == pair) == want


def test_a_chain_that_crowded_prefixes_would_hide(spark):
    # Thirty ways back from 1 to 0 rank before the way from 3 over 4, and all of them use the only edge from 0 to 1.
    rows = [(0, 1, "CAUSES", 0.9)] + [(1, 0, "CAUSES", 0.9)] * 30 + [(3, 4, "CAUSES", 0.9), (4, 0, "CAUSES", 0.9)]
    names = spark.createDataFrame([(0, "x"), (3, "x"), (1, "y")], "assertion_id bigint, name string")
    pairs = spark.createDataFrame([("p", "x", "y")], "pair_id string, source_concept string, target_concept string")
    got = P.causal_chains(pairs, names, edges(spark, rows), 3, per_pair=2).collect()
    assert sorted(tuple(r.edge_ids) for r in got) == [(0,), (31, 32, 0)]


def test_representatives_keep_the_best_for_every_suffix(spark):
    rng = random.Random(4)
    family = sorted({tuple(rng.sample(range(7), 3)) for _ in range(160)})
    frame = spark.createDataFrame([(1, list(f)) for f in family], "k int, edge_ids array<bigint>")
    kept = sorted(tuple(r.edge_ids) for r in P.representatives(frame, ["k"], 3, 1, 2).collect())
    assert len(kept) < len(family)
    for taken in range(7):
        avoid = [[f for f in some if taken not in f][:2] for some in (family, kept)]
        assert avoid[0] == avoid[1]


def test_causal_chains_through_a_hub_of_many_edges(spark):
    n = 100_000
    # Sources x lead into a hub along n edges, the hub leads back out along n more, and a few of those arrive.
    into = spark.range(n).selectExpr("id + 10 as src", "0L as dst", "id as edge_id")
    out = spark.range(n).selectExpr("0L as src", f"id + 10 + {n} as dst", f"id + {n} as edge_id")
    hub = into.unionByName(out).selectExpr("src", "dst", "'CAUSES' as type", "edge_id", "0.5D as confidence")
    names = spark.range(n).selectExpr("id + 10 as assertion_id", "'x' as name").unionByName(
        spark.range(n).selectExpr(f"id + 10 + {n} as assertion_id", "'y' as name"))
    pairs = spark.createDataFrame([("p", "x", "y")], "pair_id string, source_concept string, target_concept string")
    got = P.causal_chains(pairs, names, hub, 3).collect()
    assert sorted(tuple(r.edge_ids) for r in got) == [(0, n + i) for i in range(5)]


def chain_frame(spark, rows):
    cols = "query_id bigint, target bigint, chain array<bigint>, rels array<string>, hops int, edge_ids array<bigint>, chain_confidence double, seed_rank int, conclusion string"
    df = spark.createDataFrame(rows, cols).withColumn("place", F.struct("seed_rank", (F.col("hops") == 0).alias("own"), "hops", "edge_ids"))
    return df.withColumn("chain_id", I.chain_id())


def test_chain_scope(spark):
    chains = chain_frame(spark, [(1, 2, [0, 1, 2], ["ENTAILS"] * 2, 2, [0, 1], 0.5, 1, ""), (1, 2, [1, 2], ["ENTAILS"], 1, [1], 0.6, 1, "")])
    scopes = spark.createDataFrame([(0, 1, 5, "summer", False), (0, 1, 9, None, True), (1, 2, 6, None, True)],
                                   "source_assertion_id bigint, target_assertion_id bigint, relationship_id bigint, temporal_season string, temporal_is_default boolean")
    assert [r.hops for r in I.chains_in_season(chains, scopes, "winter").collect()] == [1]
    assert I.chains_in_season(chains, scopes, "Summer").count() == 2


@pytest.mark.parametrize("roles,want", [(("warrant", "ground"), "complete"), (("warrant", "claim"), "missing_ground"),
                                        (("ground", None), "missing_warrant"), (("claim", None), "incomplete")])
def test_toulmin_completeness(spark, roles, want):
    chains = chain_frame(spark, [(1, 1, [0, 1], ["ENTAILS"], 1, [0], 0.9, 1, ""), (1, 1, [1], [], 0, [], 0.9, 1, "")])
    found = spark.createDataFrame(list(enumerate(roles)), "assertion_id bigint, discourse_role string")
    assert [r.toulmin_completeness for r in I.toulmin_completeness(chains, found).collect()] == [want]


def test_consistency(spark):
    chains = chain_frame(spark, [(1, 1, [0, 1], ["ENTAILS"], 1, [0], 0.9, 1, ""), (2, 3, [3], [], 0, [], 0.9, 1, "")])
    rows = [(7, 0, 1, "CONTRADICTS", "pending"), (8, 3, 3, "CONTRADICTS", "false_positive"), (9, 0, 3, "CONTRADICTS", "pending")]
    conflicts = spark.createDataFrame(rows, "relationship_id bigint, source_assertion_id bigint, target_assertion_id bigint, relationship_type string, review_status string")
    got = {r.query_id: r.consistency_status for r in I.consistency(chains, conflicts).collect()}
    assert got == {1: "contradictory", 2: "consistent"}


def test_derived_assertions(spark):
    chains = chain_frame(spark, [(1, 3, [0, 2, 3], ["ENTAILS", "DEFINES"], 2, [0, 1], 0.5, 1, "supports: x"), (1, 3, [2, 3], ["DEFINES"], 1, [1], 0.8, 1, "supports: x")]
                         + [(1, 4, [0, 9, 9 + i, 4], ["ENTAILS"] * 3, 3, [5, 6, 7 + i], 0.4, 2, "supports: y") for i in range(4)])
    queries = spark.createDataFrame([(1, "is it so?")], "query_id bigint, query_text string")
    seed_rows = spark.createDataFrame([(1, "[Derived via ENTAILS-ENTAILS-ENTAILS] supports: y")], "query_id bigint, claim_text string")
    rows = I.derived_assertions(queries, seed_rows, chains).collect()
    assert [(r.claim_text, r.chunk_id) for r in rows] == [("[Derived via ENTAILS-DEFINES] supports: x", None)]
    assert [(x.assertion_id, x.relation_type) for x in rows[0].derivation_chain] == [(0, "ENTAILS"), (2, "DEFINES"), (3, "")]


def test_confidence_falls_with_every_hop(spark):
    e = edges(spark, [(i, i + 1, "ENTAILS", 1.0) for i in range(5)])
    rows = P.forward_trace(seeds(spark, 0), e, claims(spark, 6), max_hops=4).orderBy("hops").collect()
    assert all(a.chain_confidence > b.chain_confidence for a, b in itertools.pairwise(rows))
