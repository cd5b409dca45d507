"""Graph construction."""

from pyspark.sql import functions as F

from claimgraph.operators import graph as G
from claimgraph.plans.registry import query, share

share("v_logical_edges", """
    select source_assertion_id as src, target_assertion_id as dst, relation_type as type, relationship_id,
           coalesce(nullif(confidence, 0), 0.8) as confidence, is_truth_preserving, is_defeasible, is_bidirectional,
           coalesce(evidence_text, '') as evidence_text, coalesce(mechanism, '') as mechanism, coalesce(strength, '') as strength
    from v_relations
    where source_assertion_id in (select assertion_id from v_assertions) and target_assertion_id in (select assertion_id from v_assertions)
    qualify row_number() over (partition by source_assertion_id, relation_type, target_assertion_id order by relationship_id) = 1""")
share("v_conflict_edges", """
    select source_assertion_id as src, target_assertion_id as dst,
           case when relationship_type = 'DUPLICATE' then 'DUPLICATE_OF' else 'CONTRADICTS' end as type, relationship_id,
           coalesce(nullif(confidence, 0), 0.8) as confidence, relationship_type as conflict_type,
           coalesce(review_status, 'pending') as review_status
    from v_conflicts
    where source_assertion_id in (select assertion_id from v_assertions) and target_assertion_id in (select assertion_id from v_assertions)
    qualify row_number() over (partition by source_assertion_id, target_assertion_id, relationship_type = 'DUPLICATE' order by relationship_id desc) = 1""")
share("v_edges", """
    select coalesce(l.src, c.src) as src, coalesce(l.dst, c.dst) as dst, coalesce(l.type, c.type) as type,
           coalesce(l.relationship_id * 2, c.relationship_id * 2 + 1) as edge_id,
           coalesce(c.confidence, l.confidence) as confidence, l.is_truth_preserving, l.is_defeasible,
           coalesce(l.evidence_text, '') as evidence_text, coalesce(l.mechanism, '') as mechanism, coalesce(l.strength, '') as strength,
           c.conflict_type, c.review_status
    from v_logical_edges l full outer join v_conflict_edges c on l.src = c.src and l.dst = c.dst and l.type = c.type""")


@query("g01_document_nodes", "select document_id, title, source_document, domain from v_docs")
def document_nodes(c):
    return G.document_nodes(c.docs)


@query("g02_chunk_edges", "select chunk_id, document_id from v_chunks where document_id in (select document_id from v_docs)")
def chunk_edges(c):
    return G.chunk_edges(c.chunks, c.docs)


@query("g03_source_edges", "select assertion_id, chunk_id from v_assertions where chunk_id in (select chunk_id from v_chunks)")
def source_edges(c):
    return G.source_edges(c.assertions, c.chunks)


share("v_name_edges", """select distinct kind, assertion_id, name from (
        select 'TAGGED_WITH' as kind, assertion_id, unnest(topics) as name from v_assertions union all
        select 'GOVERNS', assertion_id, unnest(entities) from v_assertions union all
        select 'REFERENCES', assertion_id, unnest(regulations) from v_assertions) where name <> ''""")


def name_edges(c):
    out = None
    for kind, column in [("TAGGED_WITH", "topics"), ("GOVERNS", "entities"), ("REFERENCES", "regulations")]:
        part = G.name_edges(c.assertions, column).select(F.lit(kind).alias("kind"), "assertion_id", "name")
        out = part if out is None else out.unionByName(part)
    return out


@query("g04_name_edges", "select kind, assertion_id, name from v_name_edges")
def named(c):
    return name_edges(c)


@query("g04_name_nodes", "select distinct kind, name from v_name_edges")
def name_nodes(c):
    return name_edges(c).select("kind", "name").distinct()


@query("g05_logical_edges", "select src, dst, type, relationship_id, is_truth_preserving, evidence_text from v_logical_edges")
def logical_edges(c):
    return (G.logical_edges(c.relations, c.assertions)
            .select("src", "dst", "type", "relationship_id", "is_truth_preserving", "evidence_text"))


@query("g06_edge_defaults", "select src, dst, type, confidence, mechanism, strength from v_logical_edges")
def edge_defaults(c):
    return (G.logical_edges(c.relations, c.assertions)
            .select("src", "dst", "type", "confidence", "mechanism", "strength"))


@query("g07_merged_edges", """select src, dst, type, edge_id, confidence, coalesce(conflict_type, '-') as conflict_type,
    coalesce(review_status, '-') as review_status from v_edges""")
def merged_edges(c):
    return graph_edges(c).select("src", "dst", "type", "edge_id", "confidence",
                                 F.coalesce("conflict_type", F.lit("-")).alias("conflict_type"),
                                 F.coalesce("review_status", F.lit("-")).alias("review_status"))


def graph_edges(c):
    return G.assertion_edges(c.relations, c.conflicts, c.assertions)
