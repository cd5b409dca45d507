"""Corpus curation."""

from pyspark.sql import functions as F

from claimgraph.functions import text as tx
from claimgraph.operators import chunking as K
from claimgraph.operators import curation as U
from claimgraph.plans.registry import query, share

SICS = ", ".join(f"'{s}'" for s in ["6020", "6021", "6022", "6025", "6026", "6027", "6029", "6035", "6036", "6099",
                                    "6141", "6153", "6154", "6159", "6200", "6211", "6311", "6321", "6411"])


@query("c01_filings_in_scope", f"""select accession_no, cik, sic, filing_date from v_filings
    where sic in ({SICS}) and cast(left(filing_date, 4) as int) between 1995 and 1998""")
def filings_in_scope(c):
    # The orders end in the nineties, so the year range is a parameter here.
    return U.in_scope_filings(c.filings, 1995, 1998).select("accession_no", "cik", "sic", "filing_date")


@query("c02_first_per_period", """select cik, period, min(accession_no) as accession_no from v_filings group by 1, 2""")
def first_per_period(c):
    return U.first_per_period(c.filings).select("cik", "period", "accession_no")


_latest = """select cik, accession_no, filing_date, sic from v_filings
    qualify row_number() over (partition by cik order by filing_date desc, accession_no) = 1"""


@query("c03_latest_per_firm", _latest)
def latest_per_firm(c):
    return U.latest_per_firm(c.filings).select("cik", "accession_no", "filing_date", "sic")


@query("c04_newest_firms", f"select * from ({_latest}) order by filing_date desc, accession_no limit 200")
def newest_firms(c):
    return U.newest_firms(c.filings).select("cik", "accession_no", "filing_date", "sic")


@query("c05_boilerplate_counts", """select count(*) filter (ok) as kept, count(*) filter (not ok) as dropped from (
    select length(item1) + length(item1a) >= 2000 and trim(item1a) <> '' as ok from v_filing_text)""")
def boilerplate_counts(c):
    return U.boilerplate_counts(U.with_char_count(c.filing_text))


@query("c05_substantial_filings", """select cik, length(item1) + length(item1a) as char_count from v_filing_text
    where length(item1) + length(item1a) >= 2000 and trim(item1a) <> ''""")
def substantial_filings(c):
    return U.drop_boilerplate(U.with_char_count(c.filing_text)).select("cik", "char_count")


@query("c06_extraction_failures", """select cik, period, length(item1) + length(item1a) as char_count from v_filing_text
    where item1 = '' and item1a = ''""")
def extraction_failures(c):
    return U.extraction_failures(U.with_char_count(c.filing_text)).select("cik", "period", "char_count")


@query("c07_unprocessed", "select doc_id, n_chars from documents where doc_id not in (select doc_id from labels)")
def unprocessed(c):
    return U.unprocessed(c.table("documents"), c.table("labels"), "doc_id").select("doc_id", "n_chars")


@query("c08_stage_progress", """select lang as stage, count(*) as total, count(l.doc_id) as done,
        case when count(l.doc_id) >= count(*) then 'completed' else 'running' end as status
    from documents d left join labels l on l.doc_id = d.doc_id group by lang""")
def stage_progress(c):
    marks = c.table("labels").select("doc_id", F.lit(True).alias("seen"))
    records = (c.table("documents").join(marks, "doc_id", "left")
               .select(F.col("lang").alias("stage"), F.col("seen").isNotNull().alias("done")))
    return U.stage_progress(records)


@query("c09_corpus_summary", """select count(distinct document_id) as documents, count(*) as chunks,
        round(avg(length(content)), 2) as mean_chunk_chars from v_article_chunks""")
def corpus_summary(c):
    return U.corpus_summary(K.chunk_articles(c.text))


share("v_source_category", """select source_document, min(category) as category from v_query_category group by 1""")


@query("c10_sampled_documents", """with chosen as (
        select category, source_document from (select distinct source_document from v_assertions) join v_source_category using (source_document)
        qualify row_number() over (partition by category order by md5(source_document), source_document) <= 15),
    best as (select source_document, claim_text, row_number() over (partition by source_document order by confidence desc, assertion_id) as p
        from v_assertions where source_document in (select source_document from chosen) qualify p <= 4)
    select category, source_document, left(string_agg(claim_text, ' ' order by p), 500) as excerpt
    from chosen join best using (source_document) group by 1, 2""")
def sampled_documents(c):
    categories = (c.docs.groupBy("source_document")
                  .agg(F.min(tx.query_category(F.col("title"))).alias("category")))
    return U.sample_documents(c.assertions, categories)


share("v_query_pool", """select assertion_id as query_id,
        (['normative','constative','mixed'])[assertion_id % 3 + 1] as epistemic_type, q.category as source_category
    from v_assertions a join v_query_category q using (document_id)""")


def query_pool(c):
    kind = F.get(F.array(F.lit("normative"), F.lit("constative"), F.lit("mixed")), (F.col("assertion_id") % 3).cast("int"))
    return (c.assertions.join(c.docs.select("document_id", "title"), "document_id")
            .select(F.col("assertion_id").alias("query_id"), kind.alias("epistemic_type"),
                    tx.query_category(F.col("title")).alias("source_category")))


@query("c11_stratified_queries", """with ranked as (
        select *, row_number() over (partition by epistemic_type, source_category order by query_id) > 10 as fill from v_query_pool)
    select query_id, epistemic_type, source_category from ranked
    qualify row_number() over (partition by epistemic_type order by fill, query_id) <= 50""")
def stratified_queries(c):
    return U.stratified_queries(query_pool(c)).select("query_id", "epistemic_type", "source_category")


# One template per type and cue.
TEMPLATES = [("normative", "What must a firm do about {topic}?"), ("normative", "Which duties apply to {topic}?"),
             ("constative", "What is {topic}?"), ("constative", "How large is {topic}?"),
             ("mixed", "Does {topic} meet its rules?")]
_tv = ", ".join(f"('{a}', '{b}')" for a, b in TEMPLATES)


@query("c12_template_queries", f"""with t as (select epistemic_type, list(template order by template) as ts
        from (values {_tv}) v(epistemic_type, template) group by 1),
    s as (select list(distinct subject order by subject) as vs from v_assertions),
    n as (select epistemic_type, unnest(range(n)) as number from (values ('normative', 40), ('constative', 40), ('mixed', 20)) w(epistemic_type, n))
    select epistemic_type, number, replace(ts[number % len(ts) + 1], '{{topic}}', vs[number % len(vs) + 1]) as query_text
    from n join t using (epistemic_type), s""")
def template_queries(c):
    templates = c.spark.createDataFrame(TEMPLATES, "epistemic_type string, template string")
    values = c.assertions.select(F.col("subject").alias("value")).distinct()
    return U.expand_templates(templates, values, {"normative": 40, "constative": 40, "mixed": 20})
