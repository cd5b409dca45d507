"""Assertion and relation clean-up, batches and cross-document candidates."""

from pyspark.sql import functions as F

from claimgraph.functions import summaries
from claimgraph.operators import assertions as A
from claimgraph.plans.registry import query, share
from claimgraph.plans.source_queries import grammar
from claimgraph.sources import responses

LIVE = "coalesce(epistemic_status, '') not in ('deprecated', 'orphaned')"
TRUTH = "('ENTAILS', 'EQUIVALENT', 'DEFINES', 'TRIGGERS', 'SPECIALIZES', 'GENERALIZES', 'SUPERSEDES')"


def _repeated(c):
    """Assertions with every fifth one repeated under another id and predicate."""
    again = (c.assertions.where("assertion_id % 5 = 0")
             .withColumn("assertion_id", F.col("assertion_id") + 50000)
             .withColumn("claim_text", F.concat(F.lit("  "), "claim_text"))
             .withColumn("predicate_type", F.when(F.col("line_no") % 2 == 0, "requires").otherwise("relates_to")))
    return c.assertions.unionByName(again)


@query("a01_dedup_assertions", """with r as (select assertion_id, chunk_id, claim_text, predicate_type from v_assertions union all
        select assertion_id + 50000, chunk_id, '  ' || claim_text, case when line_no % 2 = 0 then 'requires' else 'relates_to' end
        from v_assertions where assertion_id % 5 = 0)
    select assertion_id, chunk_id, predicate_type from r
    qualify row_number() over (partition by chunk_id, lower(trim(claim_text))
        order by case when predicate_type = 'relates_to' then 99 else 1 end, assertion_id) = 1""")
def dedup_assertions(c):
    return A.dedup_assertions(_repeated(c)).select("assertion_id", "chunk_id", "predicate_type")


@query("a02_enum_defaults", """select assertion_id,
        case when assertion_id % 4 = 0 then 'conditional_override' when assertion_id % 4 = 1 then 'universal' else scope_coverage end as coverage,
        case when assertion_id % 3 = 0 then 'partial' else 'unknown' end as completeness,
        case when assertion_id % 5 = 0 then 'relates_to' else predicate_type end as predicate_type
    from v_assertions""")
def enum_defaults(c):
    i = F.col("assertion_id")
    coverage = F.when(i % 4 == 0, "conditional").when(i % 4 == 1, "odd").otherwise(F.col("scope_coverage"))
    completeness = F.when(i % 3 == 0, "partial").when(i % 3 == 1, "odd")
    predicate = F.when(i % 5 == 0, "odd").otherwise(F.col("predicate_type"))
    return c.assertions.select("assertion_id", responses.normal_coverage(coverage).alias("coverage"),
                               responses.normal_completeness(completeness).alias("completeness"),
                               responses.normal_predicate(predicate).alias("predicate_type"))


_roles = "('warrant','ground','claim','backing','rebuttal','qualifier','unclassified')"


@query("a03_merge_grammar", f"""select a.assertion_id,
        case when coalesce(g.discourse_role, a.discourse_role) in {_roles} then coalesce(g.discourse_role, a.discourse_role) else 'unclassified' end as discourse_role,
        coalesce(g.validity_claim_type, a.validity_claim_type) as validity_claim_type
    from v_assertions a left join v_grammar g using (assertion_id)""")
def merge_grammar(c):
    return (A.merge_grammar(c.assertions, grammar(c))
            .select("assertion_id", "discourse_role", "validity_claim_type"))


@query("a03_unknown_grammar_values", f"""select count(*) filter (discourse_role not in {_roles}) as unknown_roles,
        count(*) filter (validity_claim_type not in ('constative','normative','expressive','unclassified')) as unknown_types from v_grammar""")
def unknown_grammar(c):
    return A.invalid_grammar(grammar(c))


@query("a04_read_defaults", """select relationship_id, coalesce(nullif(confidence, 0), 0.8) as confidence from v_relations""")
def read_defaults(c):
    return c.relations.select("relationship_id", A.positive_or(F.col("confidence")).alias("confidence"))


@query("a05_relation_flags", f"""select relationship_id, relation_type in {TRUTH} as is_truth_preserving,
        relation_type in ('CAUSES', 'INHIBITS', 'CORRELATES_WITH', 'REBUTS') as is_defeasible,
        relation_type in ('CONTRADICTS', 'EQUIVALENT', 'CORRELATES_WITH') as is_bidirectional from v_relations""")
def relation_flags(c):
    return c.relations.select("relationship_id", *A.relation_flags())


@query("a06_dedup_relations", """select min(relationship_id) as relationship_id, source_assertion_id, target_assertion_id, relation_type
    from v_relations group by 2, 3, 4""")
def dedup_relations(c):
    return A.dedup_relations(c.relations).select("relationship_id", "source_assertion_id", "target_assertion_id", "relation_type")


share("v_batches", """select document_id, assertion_id, (rn - 1) // 50 as batch, (rn - 1) % 50 as in_batch,
        count(*) over (partition by document_id, (rn - 1) // 50) as batch_rows,
        max((rn - 1) // 50) over (partition by document_id) as last_batch
    from (select document_id, assertion_id, row_number() over (partition by document_id order by line_no) as rn from v_assertions)""")


@query("a07_batches", "select document_id, assertion_id, batch, in_batch, batch_rows from v_batches where batch_rows >= 2")
def batches(c):
    return (A.working_batches(c.assertions, "document_id", F.col("line_no"))
            .select("document_id", "assertion_id", "batch", "in_batch", "batch_rows"))


@query("a08_cross_batches", """select document_id, batch as cross_batch, assertion_id from v_batches
        where batch_rows - in_batch <= 10 and batch < last_batch
    union all select document_id, batch - 1, assertion_id from v_batches where in_batch < 10 and batch > 0""")
def cross_batches(c):
    return (A.cross_batches(c.assertions, "document_id", F.col("line_no"))
            .select("document_id", "cross_batch", "assertion_id"))


def contradictions_by_document(c):
    docs = c.assertions.select(F.col("assertion_id").alias("source_assertion_id"), "document_id")
    return c.conflicts.where("relationship_type = 'DUPLICATE'").join(docs, "source_assertion_id")


@query("a09_relation_coverage", """select document_id, n as assertions, coalesce(m, 0) as relations, n < 30 or coalesce(m, 0) > 0 as is_complete,
        not (n < 30 or coalesce(m, 0) > 0) as retry
    from (select document_id, count(*) as n from v_assertions group by 1)
    left join (select a.document_id, count(*) as m from v_conflicts k join v_assertions a on a.assertion_id = k.source_assertion_id
               where k.relationship_type = 'DUPLICATE' group by 1) using (document_id)""")
def relation_coverage(c):
    # Duplicates are rare enough that some large documents have none.
    return A.relation_coverage(c.assertions, contradictions_by_document(c))


share("v_concept_links", f"""select distinct assertion_id, document_id, concept from (
        select assertion_id, document_id, unnest(entities) as concept from v_assertions where {LIVE}) where concept <> ''""")
share("v_clusters", """select concept, count(*) as size from v_concept_links group by 1 having count(*) between 2 and 50""")


@query("a10_concept_clusters", """select concept, size, string_agg(cast(assertion_id as string), '|' order by assertion_id) as members
    from v_concept_links join v_clusters using (concept) group by 1, 2""")
def concept_clusters(c):
    return (A.concept_clusters(c.assertions)
            .select("concept", "size", F.array_join(F.col("assertion_ids").cast("array<string>"), "|").alias("members")))


@query("a10_concept_members", """select concept, size, assertion_id, document_id from v_concept_links
    join (select concept, count(*) as size from v_concept_links group by 1 having count(*) >= 2) using (concept)""")
def concept_members(c):
    return A.clustered_links(c.assertions).select("concept", "size", "assertion_id", "document_id")


@query("a10_dropped_clusters", """select concept, count(*) as size from v_concept_links group by 1 having count(*) not between 2 and 50""")
def dropped_clusters(c):
    return A.dropped_clusters(c.assertions)


share("v_linked", """select distinct least(source_assertion_id, target_assertion_id) as low_id,
    greatest(source_assertion_id, target_assertion_id) as high_id from v_relations""")


@query("a11_cross_document_pairs", """select x.concept, x.assertion_id as low_id, y.assertion_id as high_id
    from v_clusters g join v_concept_links x using (concept) join v_concept_links y using (concept)
    where x.assertion_id < y.assertion_id and x.document_id is distinct from y.document_id
      and not exists (select 1 from v_linked l where l.low_id = x.assertion_id and l.high_id = y.assertion_id)""")
def cross_document_pairs(c):
    return A.cross_document_pairs(c.assertions, c.relations, A.MAX_CLUSTER)


@query("a12_accept_relations", """with f as (select relationship_id, source_assertion_id as s, target_assertion_id as t from v_conflicts
        union all select relationship_id + 7000000000000000, target_assertion_id, source_assertion_id from v_conflicts where relationship_id % 3 = 0)
    select relationship_id, s as source_assertion_id, t as target_assertion_id from f
    left join v_assertions a on a.assertion_id = s left join v_assertions b on b.assertion_id = t
    where a.document_id is distinct from b.document_id
      and not exists (select 1 from v_linked l where l.low_id = least(s, t) and l.high_id = greatest(s, t))
    qualify row_number() over (partition by least(s, t), greatest(s, t) order by relationship_id) = 1""")
def accept_relations(c):
    back = c.conflicts.where("relationship_id % 3 = 0").select(
        (F.col("relationship_id") + 7000000000000000).alias("relationship_id"),
        F.col("target_assertion_id").alias("source_assertion_id"), F.col("source_assertion_id").alias("target_assertion_id"))
    found = c.conflicts.select("relationship_id", "source_assertion_id", "target_assertion_id").unionByName(back)
    return A.accept_relations(found, c.assertions, c.relations, [F.col("relationship_id")])


@query("t23_listing_texts", f"""select document_id, batch, string_agg('ID: ' || cast(assertion_id as string) || chr(10) || 'Claim: ' || claim_text || chr(10)
            || 'Scope: ' || coalesce(nullif(concat_ws(', ',
                case when not geo_is_global then 'countries=[' || array_to_string(geo_countries, ', ') || ']' end,
                case when not temporal_is_default then 'season=' || coalesce(temporal_season, 'None') end), ''), 'universal') || chr(10),
            chr(10) order by in_batch) as listing
    from v_batches join v_assertions using (document_id, assertion_id) where batch_rows >= 2 group by 1, 2""")
def listing_texts(c):
    rows = A.working_batches(c.assertions, "document_id", F.col("line_no"))
    return summaries.join_lines(rows, ["document_id", "batch"], "in_batch", summaries.assertion_listing(), "listing")
