"""Two-pass retrieval, question evidence and proofs."""

from pyspark.sql import functions as F

from claimgraph.functions import summaries
from claimgraph.functions.ranking import top_per_key
from claimgraph.operators import inference as I
from claimgraph.operators import paths as P
from claimgraph.operators import retrieval as R
from claimgraph.operators import two_pass as W
from claimgraph.plans.registry import query, share
from claimgraph.plans.retrieval_queries import context as regulation_context_rows
from claimgraph.plans.stored import citations, found, graph_edges, stored, vectors

_TOULMIN = "('ENTAILS', 'CAUSES', 'TRIGGERS', 'SPECIALIZES')"
share("v_anchor", "select query_id, assertion_id as node from v_c where rank = 1")
share("v_e_near", f"""with e as (select here, there, edge_id from v_both where type in {_TOULMIN}),
    one as (select query_id, there as id, edge_id from v_anchor join e on here = node)
    select query_id, id as assertion_id from one where id in (select assertion_id from v_fields) union
    select query_id, there from one join e on e.here = id and e.edge_id <> one.edge_id where there in (select assertion_id from v_fields)""")
share("v_e_merged", """select query_id, assertion_id, min(struct_pack(s := s, k := k)) as o, min(obligation) as obligation, min(p1) as pass1_rank
    from (select query_id, assertion_id, 0 as s, assertion_id as k, null::bigint as obligation, null::bigint as p1 from v_e_near union all
          select query_id, assertion_id, 1, position, case when position <= 5 then 50 + position end, null from v_periphery where position <= 10 union all
          select query_id, assertion_id, 2, rank, rank, rank from v_c) group by 1, 2""")
share("v_e_rows", """with m as (select m.*, f.* exclude (assertion_id), case when validity_claim_type = 'normative' or discourse_role = 'warrant' then 'warrant'
            when discourse_role = 'backing' then 'backing' else 'ground' end as layer
        from v_e_merged m join v_fields f using (assertion_id)),
    r as (select query_id, dst as assertion_id, min(edge_id) as k from (
            select query_id, dst, edge_id from v_anchor join v_edges on src = node and type = 'REBUTS' where dst in (select assertion_id from v_fields)
            qualify row_number() over (partition by query_id order by edge_id) <= 10) group by 1, 2),
    u as (select query_id, assertion_id, o, obligation, pass1_rank, layer, validity_claim_type, claim_text, source_document from m union all
          select r.query_id, r.assertion_id, struct_pack(s := 0, k := r.k), null, null, 'rebuttal', f.validity_claim_type, f.claim_text, f.source_document
          from r join v_fields f using (assertion_id) left join m on m.query_id = r.query_id and m.assertion_id = r.assertion_id where m.query_id is null)
    select *, row_number() over (partition by query_id order by
            case when obligation is not null then 0 when layer = 'warrant' then 1 when layer = 'ground' then 2 when layer = 'backing' then 3 else 4 end,
            case when obligation is not null then 0 else o.s end, case when obligation is not null then obligation else o.k end) as position from u""")


def two_pass_rows(c):
    return stored(c, "two_pass", lambda: W.two_pass(found(c), c.assertions, graph_edges(c), citations(c)))


@query("r16_two_pass_rows", """select query_id, position, layer, assertion_id, coalesce(pass1_rank, -1) as pass1_rank,
    coalesce(obligation, -1) as obligation_position from v_e_rows""")
def two_pass(c):
    return two_pass_rows(c).select("query_id", "position", "layer", "assertion_id",
                                   F.coalesce("pass1_rank", F.lit(-1)).alias("pass1_rank"),
                                   F.coalesce("obligation_position", F.lit(-1)).alias("obligation_position"))


@query("r16_two_pass_summary", """select q.query_id, max(a.node) as anchor_assertion_id,
        coalesce(arg_min(claim_text, obligation) filter (obligation is not null and validity_claim_type = 'normative'), '') as obligation,
        coalesce(arg_min(claim_text, o) filter (layer = 'ground' and validity_claim_type = 'constative'), '') as factual_predicate,
        coalesce(arg_min(claim_text, pass1_rank) filter (pass1_rank is not null), '') as inference_warrant,
        coalesce(arg_min(claim_text, o) filter (layer = 'rebuttal'), '') as exemption_conditions,
        count(pass1_rank) as pass_1_retrieved, count(r.assertion_id) as total_retrieved,
        count(*) filter (layer <> 'rebuttal' and o.s = 0) as neighborhood_size,
        count(distinct source_document) filter (layer <> 'rebuttal') as n_sources,
        coalesce(max(p.n), 0) as conflict_pairs, coalesce(max(p.n), 0) > 0 as conflict_detected,
        count(*) filter (layer <> 'rebuttal' and o.s = 0) = 0 as completeness_warning
    from v_queries q left join v_anchor a using (query_id) left join v_e_rows r on r.query_id = q.query_id
    left join (select x.query_id, count(*) as n from v_e_rows x join v_edges e on e.src = x.assertion_id and e.type = 'CONTRADICTS'
               join v_e_rows y on y.query_id = x.query_id and y.assertion_id = e.dst group by 1) p on p.query_id = q.query_id
    group by q.query_id""")
def two_pass_summary(c):
    return W.two_pass_summary(two_pass_rows(c), c.queries, graph_edges(c))


share("v_question", """select query_id, assertion_id, f.* exclude (assertion_id), row_number() over (partition by query_id order by t.rank, assertion_id) as rank
    from v_top_chunks t join v_assertions a using (chunk_id) join v_fields f using (assertion_id)
    where t.rank <= 10 and a.confidence >= 0.5 and a.epistemic_status <> 'derived'""")
share("v_question_clash", """select x.query_id, count(*) as n from v_question x join v_conflicts k on k.source_assertion_id = x.assertion_id
        and relationship_type = 'CONTRADICTS' and review_status <> 'false_positive'
    join v_question y on y.query_id = x.query_id and y.assertion_id = k.target_assertion_id group by 1""")


@query("r21_answer_evidence", """select query_id, coalesce(max(m.n), 0) as n_assertions, coalesce(max(m.c), 0) as n_contested,
        case when coalesce(max(k.n), 0) > 0 then 'contradictory' else 'consistent' end as consistency_status,
        coalesce(max(s.ids), '') as source_ids, coalesce(max(z.n), 0) as n_causal
    from v_queries left join (select query_id, count(*) as n, count(*) filter (epistemic_status = 'contested') as c from v_question group by 1) m using (query_id)
    left join v_question_clash k using (query_id)
    left join (select query_id, string_agg(cast(assertion_id as string), '|' order by rank) as ids from v_question where rank <= 10 group by 1) s using (query_id)
    left join (select query_id, least(count(*), 10) as n from (
        select query_id from v_question q join v_edges on src = q.assertion_id where rank <= 5 and type in ('CAUSES', 'INHIBITS', 'CORRELATES_WITH')
            and dst in (select assertion_id from v_fields)
        qualify row_number() over (partition by query_id, q.assertion_id order by edge_id) <= 5) group by 1) z using (query_id)
    group by query_id""")
def answer_evidence(c):
    rows = evidence(c)
    return rows.select("query_id", "n_assertions", "n_contested", "consistency_status",
                       F.coalesce(F.array_join(F.col("sources.assertion_id").cast("array<string>"), "|"), F.lit("")).alias("source_ids"),
                       F.coalesce(F.size("causal_context"), F.lit(0)).alias("n_causal"))


def evidence(c):
    chunks = R.top_chunks(c.queries, vectors(c), 10)
    return W.answer_evidence(chunks, c.queries, c.assertions, graph_edges(c), c.conflicts, citations(c), include_derived=False)


@query("r21_answer_evidence_nested")
def answer_evidence_nested(c):
    return evidence(c)


@query("t23_source_texts", """select query_id, string_agg('[' || upper(epistemic_status) || '] [toulmin_expansion] ' || claim_text || ' (source: ' || source_document
        || ', conf: ' || printf('%.2f', confidence) || ')', chr(10) || chr(10) order by rank) as context_text
    from v_question group by 1""")
def source_texts(c):
    chunks = R.top_chunks(c.queries, vectors(c), 10)
    rows = W.question_sources(chunks, c.assertions, include_derived=False)
    return summaries.join_lines(rows, ["query_id"], "rank", summaries.evidence_line(), "context_text", "\n\n")


@query("t23_trace_texts", """select query_id, string_agg('  [' || hops || ' hops, conf:' || printf('%.2f', round(conf, 2)) || '] [toulmin_expansion] via ' || relation_used || ': '
        || left(claim_text, 120), chr(10) order by p) as trace_text
    from (select query_id, hops, conf, relation_used, claim_text, row_number() over (partition by query_id order by conf desc, hops, edge_ids) as p
          from v_forward join v_assertions on assertion_id = node qualify p <= 10) group by 1""")
def trace_texts(c):
    starts = (c.assertions.where("line_no < 5").select(F.col("document_id").alias("query_id"), F.col("assertion_id").alias("node")))
    trace = P.forward_trace(starts, graph_edges(c), c.assertions).withColumnRenamed("node", "assertion_id")
    rows = top_per_key(R.fetch(trace, c.assertions), ["query_id"], [F.desc("chain_confidence"), F.col("hops"), F.col("edge_ids")], 10, rank="p")
    return summaries.join_lines(rows, ["query_id"], "p", summaries.trace_line(), "trace_text")


@query("t23_regulation_block", """with c as (
        select query_id, regulation, layer, position, source_document, '    [' || upper(discourse_role) || '] [regulation_anchor] ' || claim_text
            || ' (source: ' || source_document || ', conf: ' || printf('%.2f', confidence) || ')' as line
        from v_context join v_fields using (assertion_id)),
    l as (select query_id, regulation, case layer when 'warrant' then 1 when 'ground' then 2 else 3 end as place,
              case layer when 'warrant' then '  Warrant layer (authoritative source):' when 'ground' then '  Ground layer (peripheral documents):'
                   else '  Backing layer (institutional authority):' end || chr(10) || string_agg(line, chr(10) order by position) as text
          from c group by query_id, regulation, layer),
    d as (select query_id, regulation, string_agg(distinct source_document, ', ' order by source_document) as documents from c group by 1, 2)
    select query_id, regulation, 'Cross-document regulation-anchored context [regulation_anchor]:' || chr(10) || 'Cross-document context anchored on ['
        || regulation || '] (contributing docs: ' || any_value(documents) || '):' || chr(10) || string_agg(text, chr(10) order by place) as context_block
    from l join d using (query_id, regulation) group by 1, 2""")
def regulation_block(c):
    return summaries.regulation_block(regulation_context_rows(c))


# ---- proofs --------------------------------------------------------------------------------------

share("v_claim_seeds", """select query_id, assertion_id, f.* exclude (assertion_id), row_number() over (partition by query_id order by f.confidence desc, assertion_id) as rank
    from v_top_chunks t join v_assertions a using (chunk_id) join v_fields f using (assertion_id) where t.rank <= 10""")


def seeds(c):
    return stored(c, "claim_seeds", lambda: I.claim_seeds(c.queries, vectors(c), c.assertions))


@query("i01_claim_seeds", "select query_id, rank, assertion_id, confidence, epistemic_status from v_claim_seeds")
def claim_seeds(c):
    return (I.claim_seeds(c.queries, vectors(c), c.assertions)
            .select("query_id", "rank", "assertion_id", "confidence", "epistemic_status"))


share("v_beaten", """select distinct query_id, s.assertion_id, src as rebuttal_id from v_claim_seeds s join v_edges on dst = s.assertion_id
    where type = 'REBUTS' and src in (select assertion_id from v_fields)""")
share("v_standing", """select * from v_claim_seeds s where not exists (select 1 from v_beaten b where b.query_id = s.query_id and b.assertion_id = s.assertion_id)""")
share("v_proof_long", """with recursive e as (select src, dst, edge_id, type, confidence from v_edges
        where type in ('ENTAILS', 'DEFINES', 'TRIGGERS', 'SPECIALIZES', 'SUPERSEDES') and is_truth_preserving
          and src in (select assertion_id from v_fields) and dst in (select assertion_id from v_fields)),
    p as (select query_id, assertion_id as target, src as head, [src, assertion_id] as chain, [edge_id] as back_ids, [type] as rels, [e.confidence] as confs, 1::bigint as hops
          from v_standing join e on e.dst = assertion_id
          union all
          select query_id, target, e.src, list_prepend(e.src, chain), list_append(back_ids, edge_id), list_prepend(type, rels),
                 list_prepend(confidence, confs), hops + 1
          from p join e on e.dst = p.head where hops < 4 and not list_contains(back_ids, edge_id))
    select * from p qualify row_number() over (partition by query_id, target order by hops, back_ids) <= 20""")
share("v_chains", """select query_id, target, s.rank as seed_rank, chain, rels, hops, list_reverse(back_ids) as edge_ids, list_product(confs) * pow(0.9, hops) as conf,
        'supports: ' || left(claim_text, 100) as conclusion, false as own
    from v_proof_long p join v_standing s using (query_id) where s.assertion_id = target
    union all select query_id, assertion_id, rank, [assertion_id], [], 0, [], confidence, 'direct: ' || left(claim_text, 100), true from v_standing""")


def chains(c):
    return stored(c, "chains", lambda: I.proof_chains(seeds(c), graph_edges(c), c.assertions))


@query("i02_chains_in_season", """with scoped as (select source_assertion_id as s, target_assertion_id as t
        from v_relations join v_assertions on assertion_id = source_assertion_id
        qualify row_number() over (partition by source_assertion_id, target_assertion_id order by relationship_id) = 1
            and not temporal_is_default and temporal_season <> 'winter'),
    hops as (select query_id, target, edge_ids, unnest(chain[1:len(chain) - 1]) as s, unnest(chain[2:]) as t from v_chains where hops > 0)
    select query_id, target, array_to_string(edge_ids, '>') as path from hops left join scoped using (s, t)
    group by query_id, target, edge_ids having count(scoped.s) = 0""")
def chains_in_season(c):
    scopes = c.relations.join(c.assertions.select(F.col("assertion_id").alias("source_assertion_id"), "temporal_season", "temporal_is_default"),
                              "source_assertion_id")
    rows = I.chains_in_season(chains(c).where("hops > 0"), scopes, "winter")
    return rows.select("query_id", "target", F.array_join(F.col("edge_ids").cast("array<string>"), ">").alias("path"))


@query("i03_proof_chains", """select query_id, target, seed_rank, array_to_string(chain, '>') as chain, array_to_string(rels, '>') as rels, hops, round(conf, 9) as chain_confidence,
    conclusion from v_chains""")
def proof_chains(c):
    rows = I.proof_chains(seeds(c), graph_edges(c), c.assertions)
    return rows.select("query_id", "target", "seed_rank", F.array_join(F.col("chain").cast("array<string>"), ">").alias("chain"),
                       F.array_join("rels", ">").alias("rels"), "hops", F.round("chain_confidence", 9).alias("chain_confidence"), "conclusion")


share("v_chain_best", """select query_id, chain, conf from v_chains
    qualify row_number() over (partition by query_id order by round(conf, 12) desc, seed_rank, own, hops, edge_ids) = 1""")
share("v_consistency", """select query_id, case when count(k.relationship_id) > 0 then 'contradictory' else 'consistent' end as consistency_status
    from (select distinct query_id, unnest(chain) as id from v_chains) x
    left join (select k.*, y.query_id as q2 from v_conflicts k join (select distinct query_id, unnest(chain) as id from v_chains) y on y.id = k.target_assertion_id
               where relationship_type = 'CONTRADICTS' and review_status <> 'false_positive') k on k.source_assertion_id = x.id and k.q2 = x.query_id
    group by 1""")
share("v_complete", """select query_id, case when bool_or(discourse_role = 'warrant') and bool_or(discourse_role = 'ground') then 'complete'
        when bool_or(discourse_role = 'warrant') then 'missing_ground' when bool_or(discourse_role = 'ground') then 'missing_warrant' else 'incomplete' end as toulmin_completeness
    from (select query_id, unnest(chain) as assertion_id from v_chain_best) join v_assertions using (assertion_id) group by 1""")


@query("i03_proof_verdicts", """select query_id, case when n is null then 'inconclusive' when consistency_status = 'contradictory' then 'conflicted' else 'proven' end as conclusion,
        coalesce(round(conf, 9), 0) as confidence, coalesce(consistency_status, 'incomplete') as consistency_status,
        coalesce(toulmin_completeness, 'incomplete') as toulmin_completeness, coalesce(n, 0) as n_chains, coalesce(contested, 0) as contested_seeds,
        coalesce(d, 0) as defeated_seeds, coalesce(r, 0) as active_rebuttals
    from v_queries left join (select query_id, count(*) as n from v_chains group by 1) using (query_id)
    left join v_chain_best using (query_id) left join v_consistency using (query_id) left join v_complete using (query_id)
    left join (select query_id, count(*) filter (epistemic_status = 'contested') as contested from v_claim_seeds group by 1) using (query_id)
    left join (select query_id, count(distinct assertion_id) as d, count(*) as r from v_beaten group by 1) using (query_id)""")
def proof_verdicts(c):
    out = I.prove(c.queries, seeds(c), chains(c), graph_edges(c), c.assertions, c.conflicts)
    return out.withColumn("confidence", F.round("confidence", 9))


@query("i03_first_chains", """select query_id, target, hops, array_to_string(edge_ids, '>') as path, row_number() over (partition by query_id order by seed_rank, own, hops, edge_ids) as position
    from v_chains qualify position <= 20""")
def first_chains(c):
    return I.first_chains(chains(c)).select("query_id", "target", "hops", F.array_join(F.col("edge_ids").cast("array<string>"), ">").alias("path"), "position")


@query("i04_consistency", "select query_id, consistency_status from v_consistency")
def consistency(c):
    return I.consistency(chains(c), c.conflicts)


@query("i05_toulmin_completeness", "select query_id, toulmin_completeness from v_complete")
def toulmin_completeness(c):
    return I.toulmin_completeness(chains(c), c.assertions)


@query("i06_derived_assertions", """select query_id, claim_text, object_text, round(conf, 9) as confidence, array_to_string(chain, '>') as derivation
    from (select query_id, '[Derived via ' || array_to_string(rels, '-') || '] ' || conclusion as claim_text, conf, chain from v_chains where hops >= 2
          qualify row_number() over (partition by query_id order by seed_rank, own, hops, edge_ids) <= 3)
    join (select query_id, query_text as object_text from v_queries) using (query_id)""")
def derived_assertions(c):
    rows = I.derived_assertions(c.queries, seeds(c), chains(c))
    return rows.select("query_id", "claim_text", "object_text", F.round("confidence", 9).alias("confidence"),
                       F.array_join(F.col("derivation_chain.assertion_id").cast("array<string>"), ">").alias("derivation"))
