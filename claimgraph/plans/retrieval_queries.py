"""Vector search, retrieval conditions and evidence."""

from pyspark.sql import functions as F

from claimgraph.operators import evidence as E
from claimgraph.operators import graph as G
from claimgraph.operators import retrieval as R
from claimgraph.plans.registry import query, share
from claimgraph.plans.stored import citations, graph_edges, vectors
from claimgraph.session import cut_lineage
from claimgraph.sources.derived import DOMAINS
from claimgraph.sources.ids import decode, encode, number_ids

share("v_scores", """
    select q.query_id, q.epistemic_type, c.chunk_id, c.document_id,
           round(list_dot_product(q.v, c.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(c.v, c.v)), 9) as score
    from (select query_id, epistemic_type, list_transform(vector, lambda x: cast(x as double)) as v from v_queries) q,
         (select chunk_id, document_id, list_transform(vector, lambda x: cast(x as double)) as v from v_vectors) c""")
share("v_top_chunks", """select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank
    from v_scores""")
share("v_found", """
    select query_id, epistemic_type, want, assertion_id, score,
           row_number() over (partition by query_id, want order by score desc, assertion_id) as rank
    from (select s.query_id, s.epistemic_type, w.want, a.assertion_id, s.score
          from v_scores s join v_assertions a using (chunk_id), (values (0::bigint, 'any'), (1::bigint, 'normative'), (2::bigint, 'constative')) w(want, kind)
          where (w.want = 0 or a.validity_claim_type = w.kind)
            and (w.want = 0 or s.epistemic_type = w.kind or s.epistemic_type = 'mixed'))
    qualify rank <= 200""")
share("v_fields", """select assertion_id, coalesce(nullif(confidence, 0), 0.8) as confidence, validity_claim_type, discourse_role, source_document,
    epistemic_status, claim_text from v_assertions where coalesce(epistemic_status, '') not in ('deprecated', 'orphaned')""")


@query("r01_top_chunks", "select query_id, rank, chunk_id, score from v_top_chunks where rank <= 50")
def top_chunks(c):
    return R.top_chunks(c.queries, vectors(c), 50)


_domain = "(['" + "','".join(DOMAINS) + "'])[query_id % 4 + 1]"


@query("r02_domain_search", f"""with hits as (
        select s.query_id, s.chunk_id, s.score from v_scores s join v_docs d using (document_id) where d.domain = {_domain}
        qualify row_number() over (partition by query_id order by score desc, chunk_id) <= 10)
    select query_id, a.assertion_id, score as similarity_score from hits h join v_assertions a using (chunk_id)
    where a.confidence >= 0.5 and a.domain = {_domain} and coalesce(a.epistemic_status, '') not in ('deprecated', 'orphaned')""")
def domain_search(c):
    domain = F.get(F.array(*[F.lit(d) for d in DOMAINS]), (F.col("query_id") % 4).cast("int"))
    queries = c.queries.withColumn("domain", domain)
    placed = vectors(c).join(c.docs.select("document_id", "domain"), "document_id")
    hits = R.top_chunks_of_domain(queries, placed, DOMAINS, 10).withColumn("domain", domain)
    claims = c.assertions.where("confidence >= 0.5").select("chunk_id", "domain", "assertion_id")
    found = hits.join(claims, ["chunk_id", "domain"])
    return R.fetch(found, c.assertions).select("query_id", "assertion_id", F.col("score").alias("similarity_score"))


@query("r03_chunk_assertions", """select query_id, assertion_id, confidence from v_top_chunks join v_assertions using (chunk_id)
    join v_queries using (query_id)
    where rank <= 10 and coalesce(epistemic_status, '') not in ('deprecated', 'orphaned')
      and (epistemic_type = 'mixed' or validity_claim_type = epistemic_type)""")
def chunk_assertions(c):
    rows = R.assertions_of_chunks(R.top_chunks(c.queries, vectors(c), 10).select("query_id", "chunk_id"), c.assertions)
    kinds = c.queries.select("query_id", "epistemic_type")
    return (rows.join(kinds, "query_id").where("epistemic_type = 'mixed' or validity_claim_type = epistemic_type")
            .select("query_id", "assertion_id", "confidence"))


def found(c, k=50):
    return R.search(c.queries, c.assertions, vectors(c), k)


@query("r04_fetch_by_rank", """select query_id, rank, assertion_id, confidence from v_found join v_fields using (assertion_id)
    where want = 0 and rank <= 50""")
def fetch_by_rank(c):
    return (R.fetch(found(c).where("want = 0"), c.assertions)
            .select("query_id", "rank", "assertion_id", "confidence"))


@query("r05_assertion_vectors", """select assertion_id, chunk_id, validity_claim_type,
        round(list_sum(list_transform(vector, lambda x: cast(x as double))), 5) as vector_sum
    from v_assertions join v_vectors using (chunk_id)""")
def assertion_vectors(c):
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return (R.assertion_vectors(c.assertions, vectors(c))
            .select("assertion_id", "chunk_id", "validity_claim_type", F.round(total, 5).alias("vector_sum")))


@query("r05_assertions_without_vector", """select count(*) as skipped from v_assertions
    where chunk_id not in (select chunk_id from v_vectors where document_id % 7 <> 0)""")
def assertions_without_vector(c):
    return R.assertions_without_vector(c.assertions, vectors(c).where("document_id % 7 <> 0"))


@query("r06_top_assertions", "select query_id, want, rank, assertion_id, score from v_found where rank <= 50")
def top_assertions(c):
    return R.top_assertions(R.requests_for(c.queries), c.assertions, vectors(c), 50)


share("v_cond_a1", """select query_id, assertion_id, f.confidence, f.validity_claim_type,
        row_number() over (partition by query_id order by f.confidence desc, assertion_id) as rank
    from v_top_chunks t join v_assertions a using (chunk_id) join v_fields f using (assertion_id) where t.rank <= 50""")


@query("r07_condition_a_v1", "select query_id, rank, assertion_id, confidence from v_cond_a1")
def condition_a_v1(c):
    return (R.condition_a_v1(R.top_chunks(c.queries, vectors(c), 50), c.assertions)
            .select("query_id", "rank", "assertion_id", "confidence"))


share("v_cond_a", """select query_id, row_number() over (partition by query_id order by rank) as rank, assertion_id, f.* exclude (assertion_id)
    from v_found join v_fields f using (assertion_id) where want = 0 and rank <= 50""")


@query("r08_condition_a", "select query_id, rank, assertion_id, confidence from v_cond_a")
def condition_a(c):
    return R.condition_a(found(c), c.assertions).select("query_id", "rank", "assertion_id", "confidence")


def _widened_sql(seeds, n, cap):
    return f"""with near as (select query_id, there from (
            select distinct s.query_id, there from {seeds} s join v_both on here = s.assertion_id
            where s.rank <= 10 and there in (select assertion_id from v_fields))
        qualify row_number() over (partition by query_id order by there) <= 200),
    fresh as (select n.query_id, n.there from near n left join {seeds} o on o.query_id = n.query_id and o.assertion_id = n.there
        where o.query_id is null qualify row_number() over (partition by n.query_id order by n.there) <= {n})
    select query_id, assertion_id, confidence, validity_claim_type,
           row_number() over (partition by query_id order by confidence desc, assertion_id) as rank from (
        select query_id, assertion_id, confidence, validity_claim_type from {seeds} union all
        select query_id, there, f.confidence, f.validity_claim_type from fresh join v_fields f on f.assertion_id = there) {cap}"""


share("v_cond_b", _widened_sql("v_cond_a", 50, "qualify rank <= 50"))
share("v_cond_b1", _widened_sql("v_cond_a1", 50, ""))


@query("r09_condition_b", "select query_id, rank, assertion_id, confidence from v_cond_b")
def condition_b(c):
    return (R.condition_b(found(c), c.assertions, graph_edges(c))
            .select("query_id", "rank", "assertion_id", "confidence"))


@query("r09_condition_b_text_ids", """select 'q-' || printf('%016x', query_id) as query_id, rank,
        'a-' || printf('%016x', assertion_id) as assertion_id, confidence from v_cond_b""")
def condition_b_text_ids(c):
    """The same search and graph where every id is text, the way readers and parsers give it."""
    def text(df, **kinds):
        for column, kind in kinds.items():
            df = df.withColumn(column, F.concat(F.lit(kind + "-"), F.lower(F.lpad(F.hex(column), 16, "0"))))
        return df

    assertions = text(c.assertions, assertion_id="a", chunk_id="c")
    vectors_of = text(c.vectors, chunk_id="c")
    asked = text(c.queries, query_id="q")
    ends = {"source_assertion_id": "a", "target_assertion_id": "a"}
    relations, conflicts = text(c.relations, **ends), text(c.conflicts, **ends)
    ids = number_ids(assertions.select("assertion_id"), vectors_of.select("chunk_id"), asked.select("query_id"))
    assertions = cut_lineage(encode(assertions, ids, "assertion_id", "chunk_id"))
    edges = G.assertion_edges(encode(relations, ids, *ends), encode(conflicts, ids, *ends), assertions)
    hits = cut_lineage(R.search(encode(asked, ids, "query_id"), assertions, encode(vectors_of, ids, "chunk_id"), 50))
    found_b = R.condition_b(hits, assertions, edges).select("query_id", "rank", "assertion_id", "confidence")
    return decode(found_b, ids, "query_id", "assertion_id")


@query("r09_condition_b_v1", "select query_id, rank, assertion_id, confidence from v_cond_b1")
def condition_b_v1(c):
    return (R.condition_b_v1(R.top_chunks(c.queries, vectors(c), 50), c.assertions, graph_edges(c))
            .select("query_id", "rank", "assertion_id", "confidence"))


share("v_cond_c", """select query_id, epistemic_type, assertion_id, f.* exclude (assertion_id), row_number() over (partition by query_id order by
            case when epistemic_type = 'mixed' then -f.confidence else rank end, assertion_id) as rank
    from v_found join v_fields f using (assertion_id) where want > 0 and rank <= 50""")
share("v_c", "select * from v_cond_c where rank <= 50")
share("v_c1", """select query_id, assertion_id, a.confidence, a.validity_claim_type,
        row_number() over (partition by query_id order by a.confidence desc, assertion_id) as rank
    from v_cond_a1 a join v_queries using (query_id)
    where epistemic_type = validity_claim_type or (epistemic_type = 'mixed' and validity_claim_type in ('normative', 'constative'))""")


@query("r10_condition_c", "select query_id, rank, assertion_id, confidence from v_c")
def condition_c(c):
    return R.condition_c(found(c), c.assertions).select("query_id", "rank", "assertion_id", "confidence")


@query("r10_condition_c_v1", "select query_id, rank, assertion_id, confidence from v_c1")
def condition_c_v1(c):
    return (R.condition_c_v1(R.top_chunks(c.queries, vectors(c), 50), c.queries, c.assertions)
            .select("query_id", "rank", "assertion_id", "confidence"))


share("v_cites", "select assertion_id, name from v_name_edges where kind = 'REFERENCES'")
share("v_citing", "select name, f.* from v_cites join v_fields f using (assertion_id)")
share("v_authority", """select name, source_document as authority from (select name, source_document, count(*) as n from v_citing group by 1, 2)
    qualify row_number() over (partition by name order by n desc, source_document) = 1""")
share("v_reg_best", """select name, authority, assertion_id, row_number() over (partition by name order by raw desc, assertion_id) as position
    from (select name, authority, c.assertion_id, a.confidence as raw from v_citing c join v_authority using (name) join v_assertions a using (assertion_id)
          where c.source_document <> authority) qualify position <= 15""")


def periphery_sql(seeds):
    return f"""select query_id, name as regulation, authority, assertion_id, position from (
            select s.query_id, t.name from {seeds} s join v_cites t using (assertion_id)
            left join (select name, count(*) as n from v_citing group by 1) n on n.name = t.name
            where s.rank <= 5
            qualify row_number() over (partition by s.query_id order by coalesce(n.n, 0) desc, t.name) = 1)
        join v_reg_best using (name)"""


share("v_periphery", periphery_sql("v_c"))
share("v_periphery1", periphery_sql("v_c1"))


@query("r14_regulation_periphery", "select * from v_periphery")
def regulation_periphery(c):
    seeds = R.condition_c(found(c), c.assertions)
    return E.regulation_periphery(seeds.where("rank <= 5"), citations(c), c.assertions)


def _expanded(seeds, types):
    return f"""select query_id, id as assertion_id from (
            select s.query_id, e.dst as id from {seeds} s join v_edges e on e.src = s.assertion_id
            where s.rank <= 5 and e.type in {types} and e.is_truth_preserving
            union
            select s.query_id, g.dst from {seeds} s join v_edges e on e.src = s.assertion_id join v_edges g on g.src = e.dst and g.edge_id <> e.edge_id
            where s.rank <= 5 and e.type in {types} and e.is_truth_preserving and g.type in {types} and g.is_truth_preserving)
        where id in (select assertion_id from v_fields)
        qualify row_number() over (partition by query_id order by id) <= 100"""


_PROOF = "('ENTAILS', 'DEFINES', 'TRIGGERS', 'SPECIALIZES', 'SUPERSEDES')"
_TOULMIN = "('ENTAILS', 'CAUSES', 'TRIGGERS', 'SPECIALIZES')"


def _condition_d(seeds, types, periphery, cap):
    leg = f"union select query_id, assertion_id from {periphery}" if periphery else ""
    return f"""select query_id, assertion_id, f.confidence, f.validity_claim_type,
            row_number() over (partition by query_id order by f.confidence desc, assertion_id) as rank
        from (select query_id, assertion_id from {seeds} union select query_id, assertion_id from ({_expanded(seeds, types)}) {leg})
        join v_fields f using (assertion_id) {cap}"""


share("v_cond_d1", _condition_d("v_c1", _PROOF, "v_periphery1", ""))
share("v_cond_d2", _condition_d("v_c", _PROOF, "v_periphery", "qualify rank <= 50"))
share("v_cond_d4", _condition_d("v_c", _TOULMIN, "v_periphery", "qualify rank <= 50"))
share("v_cond_df", _condition_d("v_c", _TOULMIN, None, "qualify rank <= 50"))


@query("r11_condition_d_v1", "select query_id, rank, assertion_id, confidence from v_cond_d1")
def condition_d_v1(c):
    return (R.condition_d_v1(R.top_chunks(c.queries, vectors(c), 50), c.queries, c.assertions, graph_edges(c), citations(c))
            .select("query_id", "rank", "assertion_id", "confidence"))


def condition_d(c, variant):
    return (R.condition_d(found(c), c.assertions, graph_edges(c), citations(c), variant)
            .select("query_id", "rank", "assertion_id", "confidence"))


@query("r12_condition_d_v2", "select query_id, rank, assertion_id, confidence from v_cond_d2")
def condition_d_v2(c):
    return condition_d(c, "v2")


@query("r12_condition_d_v4", "select query_id, rank, assertion_id, confidence from v_cond_d4")
def condition_d_v4(c):
    return condition_d(c, "v4")


def pairs_sql(results):
    return f"""select a.query_id, e.src, e.dst from {results} a join v_edges e on e.src = a.assertion_id and e.type = 'CONTRADICTS'
        join {results} b on b.query_id = a.query_id and b.assertion_id = e.dst"""


@query("r12_conflict_flags", f"""select query_id, coalesce(n, 0) as conflict_pairs, coalesce(n, 0) > 0 as conflicts_detected
    from v_queries left join (select query_id, count(*) as n from ({pairs_sql('v_cond_d4')}) group by 1) using (query_id)""")
def conflict_flags(c):
    return R.conflict_flags(condition_d_v4(c), c.queries, graph_edges(c))


@query("r13_condition_d_filings", "select query_id, rank, assertion_id, confidence from v_cond_df")
def condition_d_filings(c):
    return condition_d(c, "filings")


@query("x12_graph_contradictions", pairs_sql("v_cond_b1"))
def graph_contradictions(c):
    return E.graph_contradictions(condition_b_v1(c), graph_edges(c)).select("query_id", "src", "dst")


@query("x11_table_contradictions", """select a.query_id, k.relationship_id from v_cond_b1 a
    join v_conflicts k on k.source_assertion_id = a.assertion_id and k.relationship_type = 'CONTRADICTS' and k.review_status <> 'false_positive'
    join v_cond_b1 b on b.query_id = a.query_id and b.assertion_id = k.target_assertion_id""")
def table_contradictions(c):
    return E.table_contradictions(condition_b_v1(c), c.conflicts).select("query_id", "relationship_id")


@query("x13_cross_source_contradictions", f"""select p.query_id, p.src, p.dst, a.source_document as src_doc, b.source_document as dst_doc
    from ({pairs_sql('v_cond_b1')}) p join v_assertions a on a.assertion_id = src join v_assertions b on b.assertion_id = dst
    where a.source_document <> b.source_document""")
def cross_source_contradictions(c):
    return (E.cross_source_contradictions(condition_b_v1(c), graph_edges(c), c.assertions)
            .select("query_id", "src", "dst", "src_doc", "dst_doc"))


share("v_first_cites", """select query_id, t.name, s.source_document as seed_doc from v_cond_a s join v_cites t using (assertion_id)
    where s.rank <= 10 qualify row_number() over (partition by query_id, t.name order by rank, assertion_id) = 1""")
share("v_reg_choice", """select query_id, name from (
        select f.query_id, f.name, (select count(*) from v_citing c where c.name = f.name and c.source_document <> f.seed_doc) as n from v_first_cites f)
    where true qualify row_number() over (partition by query_id order by n desc, name) = 1 and n > 0""")
share("v_layers", """select name, authority, layer, c.assertion_id, row_number() over (partition by name, layer order by a.confidence desc, c.assertion_id) as position
    from (select c.*, authority, case when c.source_document = authority then
                case when c.discourse_role = 'warrant' then 'warrant'
                     when not exists (select 1 from v_citing w where w.name = c.name and w.source_document = authority and w.discourse_role = 'warrant') then 'warrant' end
            when c.discourse_role in ('ground', 'backing') then c.discourse_role end as layer
          from v_citing c join v_authority using (name)) c join v_assertions a using (assertion_id)
    where layer is not null qualify position <= 5""")
share("v_context", """select query_id, name as regulation, authority, layer, position, assertion_id from v_reg_choice join v_layers using (name)""")


def context(c):
    seeds = R.condition_a(found(c), c.assertions).where("rank <= 10")
    return E.regulation_context(seeds, citations(c), c.assertions)


@query("r15_regulation_context", "select * from v_context")
def regulation_context(c):
    return context(c).select("query_id", "regulation", "authority", "layer", "position", "assertion_id")


@query("r15_context_sources", """select query_id, regulation, string_agg(distinct source_document, ', ' order by source_document) as source_documents
    from v_context join v_assertions using (assertion_id) group by 1, 2""")
def context_sources(c):
    return E.context_sources(context(c))


share("v_neutral", "select query_id, assertion_id from v_found where want = 0 and rank = 1")


@query("r17_neutral_seeds", """select query_id, case when query_id % 5 = 0 then query_id * 10000000 else assertion_id end as assertion_id from v_neutral""")
def neutral_seeds(c):
    stored = c.queries.where("query_id % 5 = 0").select("query_id", (F.col("query_id") * 10000000).alias("assertion_id"))
    return R.neutral_seeds(found(c), stored)


@query("r18_confident_seeds", "select query_id, assertion_id from v_cond_a1 where rank = 1")
def confident_seeds(c):
    return R.confident_seeds(R.condition_a_v1(R.top_chunks(c.queries, vectors(c), 50), c.assertions))


@query("r19_repetitiveness", "select query_id, round(avg(score), 9) as repetitiveness_index from v_top_chunks where rank <= 20 group by 1")
def repetitiveness(c):
    return R.repetitiveness(c.queries, vectors(c))


@query("r20_padded_top_k", """with g as (select query_id, assertion_id, rank from v_found where want = 1 and rank <= 100),
    filled as (select query_id, assertion_id, 0::bigint as tier, rank as r from g union all
        select f.query_id, f.assertion_id, 1, f.rank from v_found f left join g on g.query_id = f.query_id and g.assertion_id = f.assertion_id
        where f.want = 0 and f.rank <= 200 and g.query_id is null and f.query_id in (select query_id from g))
    select query_id, assertion_id, tier, row_number() over (partition by query_id order by tier, r) as rank from filled qualify rank <= 100""")
def padded_top_k(c):
    return R.padded_top_k(found(c, 200), 1, 100)
