"""Traversals.  Seeds are the first assertions of every document."""

from pyspark.sql import functions as F

from claimgraph.operators import graph as G
from claimgraph.operators import paths as P
from claimgraph.plans.registry import query, share
from claimgraph.plans.stored import graph_edges

PROOF = "('ENTAILS', 'DEFINES', 'TRIGGERS', 'SPECIALIZES', 'SUPERSEDES')"
TOULMIN = "('ENTAILS', 'CAUSES', 'TRIGGERS', 'SPECIALIZES')"

share("v_live", "select assertion_id from v_assertions where coalesce(epistemic_status, '') not in ('deprecated', 'orphaned')")
share("v_seeds", "select document_id as query_id, assertion_id as node, line_no + 1 as rank from v_assertions where line_no < 10")
share("v_both", """select src as here, dst as there, edge_id, type, confidence, is_truth_preserving from v_edges
    union all select dst, src, edge_id, type, confidence, is_truth_preserving from v_edges where src <> dst""")


def seeds(c, n=5):
    # Line numbers are dense per document, so the first n lines are the first n seeds.
    return (c.assertions.where(F.col("line_no") < n)
            .select(F.col("document_id").alias("query_id"), F.col("assertion_id").alias("node"),
                    (F.col("line_no") + 1).alias("rank")))


share("v_forward", f"""with recursive e as (select src, dst, edge_id, type, confidence from v_edges
        where type in {PROOF} and is_truth_preserving and src in (select assertion_id from v_live) and dst in (select assertion_id from v_live)),
    p as (select query_id, node as start, dst as node, [edge_id] as edge_ids, [type] as types, confidence * 0.9::double as conf, 1::bigint as hops
          from v_seeds join e on e.src = node where rank <= 5
          union all
          select query_id, start, e.dst, list_append(edge_ids, edge_id), list_append(types, type), conf * confidence * 0.9::double, hops + 1
          from p join e on e.src = p.node where hops < 3 and not list_contains(edge_ids, edge_id))
    select *, types[-1] as relation_used from p
    qualify row_number() over (partition by query_id, start order by conf desc, hops, edge_ids) <= 10""")


@query("p01_forward_trace", """select query_id, start, node, relation_used, hops, round(conf, 9) as chain_confidence from v_forward""")
def forward_trace(c):
    return (P.forward_trace(seeds(c), graph_edges(c), c.assertions)
            .select("query_id", "start", "node", "relation_used", "hops", F.round("chain_confidence", 9).alias("chain_confidence")))


share("v_backward", f"""with recursive e as (select src, dst, edge_id, type, confidence from v_edges
        where type in {PROOF} and is_truth_preserving and src in (select assertion_id from v_live) and dst in (select assertion_id from v_live)),
    p as (select query_id, node as target, src as head, [src, node] as chain, [edge_id] as back_ids, [type] as rels, [confidence] as confs, 1::bigint as hops
          from v_seeds join e on e.dst = node where rank <= 5
          union all
          select query_id, target, e.src, list_prepend(e.src, chain), list_append(back_ids, edge_id), list_prepend(type, rels),
                 list_prepend(confidence, confs), hops + 1
          from p join e on e.dst = p.head where hops < 4 and not list_contains(back_ids, edge_id))
    select * from p qualify row_number() over (partition by query_id, target order by hops, back_ids) <= 20""")


@query("p02_backward_chains", """select query_id, target, array_to_string(chain, '>') as chain, array_to_string(rels, '>') as rels, hops from v_backward""")
def backward_chains(c):
    found = P.backward_chains(seeds(c), graph_edges(c), c.assertions)
    return found.select("query_id", "target", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"),
                        F.array_join("rels", ">").alias("rels"), "hops")


@query("p03_chain_confidence", """select query_id, target, array_to_string(chain, '>') as chain, array_to_string(rels, '>') as rels,
    round(list_product(confs) * pow(0.9, hops), 9) as chain_confidence from v_backward""")
def chain_confidence(c):
    found = P.backward_chains(seeds(c), graph_edges(c), c.assertions)
    return found.select("query_id", "target", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"),
                        F.array_join("rels", ">").alias("rels"),
                        F.round(P.chain_confidence(F.col("confs"), F.col("hops")), 9).alias("chain_confidence"))


@query("p04_causal_context", """select query_id, node as seed, dst as target, type, mechanism, strength from v_seeds join v_edges on src = node
    where rank <= 5 and type in ('CAUSES', 'INHIBITS', 'CORRELATES_WITH') and dst in (select assertion_id from v_live)
    qualify row_number() over (partition by query_id, node order by edge_id) <= 5""")
def causal_context(c):
    return P.causal_context(seeds(c), graph_edges(c), c.assertions).drop("edge_id")


@query("p05_directed_neighborhood", f"""with e as (select src, dst, edge_id from v_edges where type in {TOULMIN}),
    one as (select query_id, dst as id, edge_id from v_seeds join e on src = node where rank <= 5)
    select query_id, id as assertion_id from one where id in (select assertion_id from v_live) union
    select query_id, dst from one join e on e.src = id and e.edge_id <> one.edge_id where dst in (select assertion_id from v_live)""")
def directed_neighborhood(c):
    return P.toulmin_neighborhood(seeds(c), graph_edges(c), c.assertions, directed=True)


share("v_neighborhood", f"""with e as (select here, there, edge_id from v_both where type in {TOULMIN}),
    one as (select query_id, there as id, edge_id from v_seeds join e on here = node where rank <= 5)
    select query_id, id as assertion_id from one where id in (select assertion_id from v_live) union
    select query_id, there from one join e on e.here = id and e.edge_id <> one.edge_id where there in (select assertion_id from v_live)""")


@query("p06_undirected_neighborhood", "select query_id, assertion_id from v_neighborhood")
def undirected_neighborhood(c):
    return P.toulmin_neighborhood(seeds(c), graph_edges(c), c.assertions)


def _expansion(types):
    return f"""with e as (select src, dst, edge_id from v_edges where type in {types} and is_truth_preserving),
    one as (select query_id, dst as id, edge_id from v_seeds join e on src = node where rank <= 5)
    select query_id, id as assertion_id from (
        select query_id, id from one union
        select query_id, dst from one join e on e.src = id and e.edge_id <> one.edge_id)
    where id in (select assertion_id from v_live)
    qualify row_number() over (partition by query_id order by id) <= 100"""


@query("p07_proof_expansion", _expansion(PROOF))
def proof_expansion(c):
    return P.toulmin_expansion(seeds(c), graph_edges(c), c.assertions, "v2")


@query("p08_argument_expansion", _expansion(TOULMIN))
def argument_expansion(c):
    return P.toulmin_expansion(seeds(c), graph_edges(c), c.assertions, "v4")


@query("p09_generic_expansion", """select query_id, there as assertion_id from (
        select distinct query_id, there from v_seeds join v_both on here = node where rank <= 10)
    where there in (select assertion_id from v_live)
    qualify row_number() over (partition by query_id order by there) <= 200""")
def generic_expansion(c):
    return P.generic_expansion(seeds(c, 10), graph_edges(c), c.assertions)


share("v_all_edges", """
    select 'A:' || src as src, 'A:' || dst as dst, 'L' || lpad(cast(edge_id as string), 20, '0') as edge_id from v_edges union all
    select 'C:' || chunk_id, 'D:' || document_id, 'CHUNK_OF|' || chunk_id || '|' || document_id from v_chunks union all
    select 'A:' || assertion_id, 'C:' || chunk_id, 'SOURCED_FROM|' || assertion_id || '|' || chunk_id from v_assertions union all
    select 'A:' || assertion_id, case kind when 'TAGGED_WITH' then 'T:' when 'GOVERNS' then 'K:' else 'R:' end || name,
           kind || '|' || assertion_id || '|' || name from v_name_edges""")
share("v_near_paths", """with e as (select src as here, dst as there, edge_id from v_all_edges union all
        select dst, src, edge_id from v_all_edges where src <> dst),
    one as (select query_id, 'A:' || node as start, there as node, [edge_id] as edge_ids, ['A:' || node, there] as nodes, 1::bigint as hops
            from v_seeds join e on here = 'A:' || node where rank = 1),
    two as (select query_id, start, there as node, list_append(edge_ids, edge_id) as edge_ids, list_append(nodes, there) as nodes, 2::bigint as hops
            from one join e on e.here = one.node and e.edge_id <> edge_ids[1])
    select * from (select * from one union all select * from two)
    qualify row_number() over (partition by query_id, start order by hops, edge_ids) <= 100""")


def near_paths(c):
    centres = seeds(c, 1).select("query_id", G.typed_id("A", "node").alias("node"))
    return P.neighborhood_paths(centres, G.all_edges(graph_edges(c), c.assertions, c.chunks, c.docs))


@query("p10_neighborhood_paths", "select query_id, hops, array_to_string(edge_ids, '>') as path from v_near_paths")
def neighborhood_paths(c):
    return near_paths(c).select("query_id", "hops", F.array_join("edge_ids", ">").alias("path"))


@query("p10_neighborhood_nodes", "select distinct query_id, unnest(nodes) as node from v_near_paths")
def neighborhood_nodes(c):
    return P.neighborhood_nodes(near_paths(c))


@query("p10_neighborhood_edges", "select distinct query_id, unnest(edge_ids) as edge_id from v_near_paths")
def neighborhood_edges(c):
    return P.neighborhood_edges(near_paths(c))


@query("p11_assertion_view", """select a.assertion_id, subject, a.source_document, coalesce(type, '-') as relation_type,
        coalesce(dst, -1) as target_assertion_id, coalesce(e.confidence, -1) as edge_confidence
    from v_assertions a left join (select * from v_edges where type not in ('REBUTS', 'CONTRADICTS', 'DUPLICATE_OF')) e on src = assertion_id""")
def assertion_view(c):
    return P.assertion_view(c.assertions, graph_edges(c)).select(
        "assertion_id", "subject", "source_document", F.coalesce("relation_type", F.lit("-")).alias("relation_type"),
        F.coalesce("target_assertion_id", F.lit(-1)).alias("target_assertion_id"),
        F.coalesce("edge_confidence", F.lit(-1.0)).alias("edge_confidence"))


share("v_concept_pairs", """select distinct x.name as source_concept, y.name as target_concept from v_edges
    join v_name_edges x on x.assertion_id = src and x.kind = 'GOVERNS' and x.name like 'concept%'
    join v_name_edges y on y.assertion_id = dst and y.kind = 'GOVERNS' and y.name like 'concept%'
    where type = 'CAUSES'""")


@query("p12_causal_chains", """with recursive e as (select src, dst, edge_id from v_edges where type in ('CAUSES', 'INHIBITS')),
    g as (select assertion_id, name from v_name_edges where kind = 'GOVERNS'),
    p as (select source_concept, target_concept, dst as node, [edge_id] as edge_ids, 1::bigint as hops
          from v_concept_pairs join g on name = source_concept join e on src = assertion_id
          union all
          select source_concept, target_concept, dst, list_append(edge_ids, edge_id), hops + 1
          from p join e on src = node where hops < 3 and not list_contains(edge_ids, edge_id))
    select source_concept, target_concept, hops, array_to_string(edge_ids, '>') as path
    from p join g on g.name = target_concept and g.assertion_id = node
    qualify row_number() over (partition by source_concept, target_concept order by hops, edge_ids) <= 5""")
def causal_chains(c):
    edges, names = graph_edges(c), G.name_edges(c.assertions, "entities")
    concepts = names.where("name like 'concept%'")
    ends = (edges.where("type = 'CAUSES'").select("src", "dst")
            .join(concepts.select(F.col("assertion_id").alias("src"), F.col("name").alias("source_concept")), "src")
            .join(concepts.select(F.col("assertion_id").alias("dst"), F.col("name").alias("target_concept")), "dst"))
    pairs = (ends.select("source_concept", "target_concept").distinct()
             .withColumn("pair_id", F.concat_ws(">", "source_concept", "target_concept")))
    found = P.causal_chains(pairs, names, edges)
    return (found.join(pairs, "pair_id")
            .select("source_concept", "target_concept", "hops",
                    F.array_join(F.col("edge_ids").cast("array<string>"), ">").alias("path")))


share("v_rebuttals", """select distinct query_id, node as claim_id, src as rebuttal_id, temporal_season, temporal_is_default
    from v_seeds join v_edges on dst = node join v_assertions on assertion_id = src
    where rank <= 5 and type = 'REBUTS' and src in (select assertion_id from v_live)""")


@query("p13_rebuttals", "select query_id, claim_id, rebuttal_id from v_rebuttals")
def rebuttals(c):
    return P.rebuttals(seeds(c), graph_edges(c), c.assertions)


@query("p13_winter_rebuttals", """select query_id, claim_id, rebuttal_id from v_rebuttals
    where temporal_is_default or coalesce(temporal_season, 'winter') = 'winter'""")
def winter_rebuttals(c):
    return P.rebuttals(seeds(c), graph_edges(c), c.assertions, "Winter")


@query("p14_outgoing_rebuttals", """select query_id, node as anchor_id, dst as assertion_id from v_seeds join v_edges on src = node
    where rank <= 5 and type = 'REBUTS' and dst in (select assertion_id from v_live)
    qualify row_number() over (partition by query_id, node order by edge_id) <= 10""")
def outgoing_rebuttals(c):
    return P.outgoing_rebuttals(seeds(c), graph_edges(c), c.assertions).drop("edge_id")
