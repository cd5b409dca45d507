"""Document, node and corpus analytics."""

from pyspark.sql import functions as F

from claimgraph.operators import analytics as A
from claimgraph.operators import graph as G
from claimgraph.plans.graph_queries import graph_edges
from claimgraph.plans.registry import query, share

share("v_category", """
    select document_id, case
        when regexp_matches(lower(title), 'basel|aifmd|dodd|mifid|gdpr|sox|sarbanes|volcker|fatca|ifrs|directive| act|regulation') then 'regulatory'
        when regexp_matches(lower(title), 'risk|var|stress|concentration|operational|liquidity|credit|market') then 'risk'
        when regexp_matches(lower(title), 'capm|apt|black|scholes|arbitrage|portfolio|sharpe|markowitz') then 'financial_theory'
        when regexp_matches(lower(title), 'fund|swap|derivative|option|futures|bond|equity|etf|hedge') then 'products'
        else 'other' end as category
    from v_docs""")

share("v_readiness", """
    select d.document_id, d.title, g.category,
           count(a.assertion_id) as assertion_count,
           count(*) filter (a.discourse_role = 'warrant') as warrant_count,
           count(*) filter (a.discourse_role = 'ground') as ground_count,
           count(*) filter (a.discourse_role = 'claim') as claim_count,
           count(*) filter (a.validity_claim_type = 'normative') as normative_count,
           count(*) filter (a.validity_claim_type = 'expressive') as expressive_count,
           count(*) filter (a.assertion_id is not null and l.id is null) as isolated_count,
           cast(coalesce(sum(c.n), 0) as bigint) as conflict_count,
           round(0.3::double * least(count(a.assertion_id) / 150, 1)
                 + 0.5::double * (count(*) filter (a.validity_claim_type = 'normative')
                                  + count(*) filter (a.discourse_role = 'ground')) / greatest(count(a.assertion_id), 1)
                 + 0.2::double * (1 - count(*) filter (a.assertion_id is not null and l.id is null) / greatest(count(a.assertion_id), 1)), 3)
               as ai_readiness_score
    from v_docs d join v_category g using (document_id)
    left join v_assertions a on a.document_id = d.document_id
    left join (select source_assertion_id as id from v_relations union select target_assertion_id from v_relations) l
        on l.id = a.assertion_id
    left join (select id, count(*) as n from (
                   select source_assertion_id as id from v_conflicts where relationship_type = 'CONTRADICTS'
                   union all
                   select target_assertion_id from v_conflicts where relationship_type = 'CONTRADICTS') e group by id) c
        on c.id = a.assertion_id
    group by d.document_id, d.title, g.category""")


@query("m29_document_readiness", "select * from v_readiness")
def document_readiness(c):
    return A.document_readiness(c.docs, c.assertions, c.relations, c.conflicts)


share("v_pair_edges", """
    select a.document_id as source_doc, b.document_id as target_doc, rel_type, count(*) as edge_count,
           coalesce(((2 * cast(sum(round(r.confidence * 1000000)) as bigint) + count(r.confidence) * 1000) // nullif(2 * count(r.confidence) * 1000, 0)) / 1000, 0) as mean_confidence
    from (select source_assertion_id as s, target_assertion_id as t, relation_type as rel_type, confidence from v_relations
          union all select source_assertion_id, target_assertion_id, relationship_type, confidence from v_conflicts) r
    join v_assertions a on a.assertion_id = s join v_assertions b on b.assertion_id = t
    where a.document_id <> b.document_id or rel_type = 'CONTRADICTS' group by 1, 2, 3""")
share("v_degrees", """select id as assertion_id, count(*) as degree from (
        select source_assertion_id as id from v_relations union all select target_assertion_id from v_relations union all
        select source_assertion_id from v_conflicts union all select target_assertion_id from v_conflicts) group by 1""")


@query("m28_corpus_counters", """select 'documents' as counter, count(*) as n from v_docs union all
    select 'chunks', count(*) from v_chunks union all select 'assertions', count(*) from v_assertions union all
    select 'logical_relationships', count(*) from v_relations union all select 'conflicts', count(*) from v_conflicts union all
    select 'pending_conflicts', count(*) from v_conflict_items join v_conflicts using (relationship_id) where review_status = 'pending'""")
def corpus_counters(c):
    return A.corpus_counters(c.docs, c.chunks, c.assertions, c.relations, c.conflicts, c.conflict_items)


@query("m30_document_pair_edges", "select * from v_pair_edges")
def document_pair_edges(c):
    return pair_edges(c)


def pair_edges(c):
    return A.document_pair_edges(c.assertions, c.relations, c.conflicts)


@query("m31_top_concepts", """select name, count(*) as degree from v_name_edges where kind = 'GOVERNS' group by 1
    order by degree desc, name limit 20""")
def top_concepts(c):
    return A.top_concepts(G.name_edges(c.assertions, "entities"))


@query("m32_top_regulations", """select name, count(*) as assertion_count, count(*) filter (discourse_role = 'warrant') as warrants,
        count(distinct source_document) as doc_count from v_name_edges join v_assertions using (assertion_id)
    where kind = 'REFERENCES' group by 1 order by 2 desc, 1 limit 20""")
def top_regulations(c):
    return A.top_regulations(G.name_edges(c.assertions, "regulations"), c.assertions)


@query("m33_top_assertions", """select assertion_id, claim_text, discourse_role, validity_claim_type, document_id, degree
    from v_assertions join v_degrees using (assertion_id) order by degree desc, assertion_id limit 20""")
def top_assertions(c):
    return A.top_assertions(c.assertions, A.assertion_degrees(c.relations, c.conflicts))


@query("m34_top_document_assertions", """select document_id, assertion_id, discourse_role, validity_claim_type, confidence, coalesce(degree, 0) as degree
    from v_assertions left join v_degrees using (assertion_id)
    qualify row_number() over (partition by document_id order by coalesce(degree, 0) desc, assertion_id) <= 40""")
def top_document_assertions(c):
    return A.top_document_assertions(c.assertions, A.assertion_degrees(c.relations, c.conflicts))


_six = "('ENTAILS', 'CAUSES', 'SPECIALIZES', 'TRIGGERS', 'INHIBITS', 'REBUTS')"


@query("m26_edge_distribution", f"""select source_document, count(*) as assertions, count(*) filter (d > 0) as connected,
        count(*) filter (d = 0) as isolated, round(avg(d), 6) as avg_out_degree
    from (select a.source_document, coalesce(d, 0) as d from v_assertions a
          left join (select src, count(*) as d from v_edges where type in {_six} group by 1) on src = a.assertion_id)
    group by 1""")
def edge_distribution(c):
    return A.edge_distribution(c.assertions, graph_edges(c))


share("v_monopoly_docs", """select name as regulation, source_document, count(*) as total,
        count(*) filter (discourse_role = 'warrant') as warrants
    from v_name_edges join v_assertions using (assertion_id) where kind = 'REFERENCES' group by 1, 2""")
share("v_gini", """select regulation, case when sum(warrants) = 0 then 0.0
        else round(2 * sum(i * warrants)::double / (count(*) * sum(warrants)) - (count(*) + 1) / count(*), 4) end as gini
    from (select *, row_number() over (partition by regulation order by warrants) as i from v_monopoly_docs) group by 1""")
share("v_monopoly", """select regulation, count(*) as doc_count, cast(sum(warrants) as bigint) as total_warrants,
        cast(sum(total) as bigint) as total_assertions, any_value(gini) as gini,
        arg_min(source_document, struct_pack(w := -warrants, d := source_document)) as authoritative_source,
        round(max(warrants) / greatest(sum(warrants), 1), 4) as authoritative_share
    from v_monopoly_docs join v_gini using (regulation) group by 1 having count(*) >= 3 and sum(warrants) > 0""")


@query("m22_gini", "select regulation, gini from v_gini")
def gini(c):
    return A.gini(_warrants(c), ["regulation"], "warrants")


def _warrants(c):
    return A.warrants_by_document(G.name_edges(c.assertions, "regulations"), c.assertions)


@query("m23_warrant_monopoly", "select * from v_monopoly")
def warrant_monopoly(c):
    return A.warrant_monopoly(_warrants(c))


@query("m23_warrant_breakdown", "select * from v_monopoly_docs where regulation in (select regulation from v_monopoly)")
def warrant_breakdown(c):
    per_doc = _warrants(c)
    return per_doc.join(A.warrant_monopoly(per_doc).select("regulation"), "regulation", "left_semi")


@query("m24_monopoly_summary", """select count(*) as clusters, round(list_sort(list(gini))[cast(count(*) // 2 + 1 as int)], 4) as median_gini,
        round(avg(gini), 4) as mean_gini, round(avg(case when gini > 0.8 then 1 else 0 end), 4) as share_monopoly,
        round(avg(case when gini < 0.4 then 1 else 0 end), 4) as share_distributed from v_monopoly""")
def monopoly_summary(c):
    return A.monopoly_summary(A.warrant_monopoly(_warrants(c)))


share("v_contradictions", """select src, dst, left(a.claim_text, 120) as src_text, left(b.claim_text, 120) as tgt_text,
        a.source_document as src_doc, b.source_document as tgt_doc,
        a.validity_claim_type || '_vs_' || b.validity_claim_type as pairing, e.confidence, left(evidence_text, 300) as evidence,
        a.source_document is distinct from b.source_document as cross_document
    from v_edges e join v_assertions a on a.assertion_id = src join v_assertions b on b.assertion_id = dst
    where e.type = 'CONTRADICTS'""")


@query("m25_contradiction_profile", """select 'total' as section, 'all' as key, count(*) as n from v_contradictions union all
    select 'scope', case when cross_document then 'cross_document' else 'within_document' end, count(*) from v_contradictions group by 2 union all
    select 'pairing', pairing, count(*) from v_contradictions group by 2 union all
    select 'expressive', 'involved', count(*) from v_contradictions where pairing like '%expressive%' union all
    select 'confidence', case when confidence >= 0.9 then '0.90_1.00' when confidence >= 0.8 then '0.80_0.89'
        when confidence >= 0.7 then '0.70_0.79' else 'below_0.70' end, count(*) from v_contradictions group by 2 union all
    select 'domain', 'other', count(*) from v_contradictions""")
def contradiction_profile(c):
    return A.contradiction_profile(A.contradiction_rows(graph_edges(c), c.assertions))


# Domains come from document titles here, and confidences as the extractor left them, some of them unknown.
share("v_conflict_titles", """select d.title as src_doc, a.source_document is distinct from b.source_document as cross_document,
        coalesce(a.validity_claim_type, 'None') || '_vs_' || coalesce(b.validity_claim_type, 'None') as pairing, r.confidence
    from v_relations r join v_assertions a on a.assertion_id = r.source_assertion_id join v_assertions b on b.assertion_id = r.target_assertion_id
    join v_docs d on d.document_id = a.document_id where relation_type = 'CONTRADICTS'""")
share("v_conflict_domains", """select case
        when regexp_matches(t, 'basel|aifmd|dodd|mifid|gdpr|sox|sarbanes|volcker|ifrs|directive|regulation|act') then 'regulatory'
        when regexp_matches(t, 'risk|var|stress|concentration|operational|liquidity|credit|market') then 'risk'
        when regexp_matches(t, 'capm|apt|black|scholes|arbitrage|portfolio|sharpe|markowitz') then 'financial_theory'
        when regexp_matches(t, 'fund|swap|derivative|option|futures|bond|equity|etf|hedge') then 'products' else 'other' end as domain
    from (select lower(src_doc) as t from v_conflict_titles)""")


@query("m25_profile_by_title", """select 'total' as section, 'all' as key, count(*) as n from v_conflict_titles having count(*) > 0 union all
    select 'scope', case when cross_document then 'cross_document' else 'within_document' end, count(*) from v_conflict_titles group by 2 union all
    select 'pairing', pairing, count(*) from v_conflict_titles group by 2 union all
    select 'expressive', 'involved', count(*) from v_conflict_titles where contains(pairing, 'expressive') having count(*) > 0 union all
    select 'confidence', case when confidence is null then 'unknown' when confidence >= 0.9 then '0.90_1.00' when confidence >= 0.8 then '0.80_0.89'
        when confidence >= 0.7 then '0.70_0.79' else 'below_0.70' end, count(*) from v_conflict_titles group by 2 union all
    select 'domain', domain, count(*) from v_conflict_domains group by 2""")
def profile_by_title(c):
    titles = c.docs.select("document_id", "title")
    ends = c.relations.select(F.col("source_assertion_id").alias("src"), F.col("target_assertion_id").alias("dst"), F.col("relation_type").alias("type"),
                              "confidence", "evidence_text")
    rows = A.contradiction_rows(ends, c.assertions)
    named = c.assertions.select(F.col("assertion_id").alias("src"), "document_id").join(titles, "document_id").select("src", "title")
    return A.contradiction_profile(rows.join(named, "src").drop("src_doc").withColumnRenamed("title", "src_doc"))


@query("m25_top_contradictions", "select * from v_contradictions order by confidence desc, src, dst limit 10")
def top_contradictions(c):
    return A.top_contradictions(A.contradiction_rows(graph_edges(c), c.assertions))


@query("m35_regulatory_view", """with core as (select document_id from v_readiness where category = 'regulatory')
    select document_id, category, ai_readiness_score from v_readiness where document_id in (
        select document_id from core union select target_doc from v_pair_edges where source_doc in (select document_id from core)
        union select source_doc from v_pair_edges where target_doc in (select document_id from core))""")
def regulatory_view(c):
    return (A.regulatory_view(document_readiness(c), pair_edges(c))
            .select("document_id", "category", "ai_readiness_score"))


@query("m35_conflict_view", """select document_id, category, conflict_count from v_readiness where document_id in (
        select source_doc from v_pair_edges where rel_type = 'CONTRADICTS' union
        select target_doc from v_pair_edges where rel_type = 'CONTRADICTS')""")
def conflict_view(c):
    return A.conflict_view(document_readiness(c), pair_edges(c)).select("document_id", "category", "conflict_count")


@query("m35_ready_view", "select document_id, ai_readiness_score from v_readiness where ai_readiness_score >= 0.7")
def ready_view(c):
    return A.ready_view(document_readiness(c)).select("document_id", "ai_readiness_score")


@query("m35_confident_edges", "select * from v_pair_edges where mean_confidence >= 0.65")
def confident_edges(c):
    return A.confident_edges(pair_edges(c))


@query("m36_edge_classes", """select distinct src, dst, type from v_edges where type in
        ('ENTAILS','EQUIVALENT','DEFINES','TRIGGERS','SUPERSEDES','SPECIALIZES','GENERALIZES','CONTRADICTS','DUPLICATE_OF', 'REBUTS')""")
def edge_classes(c):
    return G.edges_of_classes(graph_edges(c), ["deductive", "conflict"])


_corpus = "case when document_id % 3 = 0 then 'filings' else 'articles' end"
_shares = f"""select corpus, validity_claim_type, count(*) as n,
        round(count(*) / sum(count(*)) over (partition by corpus), 6) as share
    from (select *, {_corpus} as corpus from v_assertions) group by 1, 2"""


def two_corpora(c):
    return c.assertions.withColumn("corpus", F.when(F.col("document_id") % 3 == 0, "filings").otherwise("articles"))


@query("m37_composition", _shares)
def composition(c):
    return A.composition(two_corpora(c))


@query("m37_composition_side_by_side", f"""select validity_claim_type, coalesce(max(share) filter (corpus = 'articles'), 0) as articles,
        coalesce(max(share) filter (corpus = 'filings'), 0) as filings from ({_shares}) group by 1""")
def composition_side_by_side(c):
    return A.composition_side_by_side(A.composition(two_corpora(c)), ["articles", "filings"])


@query("m37_assertions_per_document", f"""select corpus, count(*) as documents, cast(sum(n) as bigint) as assertions, round(avg(n), 6) as per_document
    from (select {_corpus} as corpus, document_id, count(*) as n from v_assertions group by 1, 2) group by 1""")
def assertions_per_document(c):
    return A.assertions_per_document(two_corpora(c))
