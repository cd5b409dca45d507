"""Chunking, text functions and annotators."""

from pyspark.sql import functions as F

from claimgraph.functions import annotate, summaries
from claimgraph.functions import text as tx
from claimgraph.operators import chunking as K
from claimgraph.plans.registry import query, share

WS = "' ' || chr(9) || chr(10) || chr(13)"
HEAD = r"(?m)^={2,3}\s*(.+?)\s*={2,3}\s*$"
HEAD_SPLIT = r"(?m)^={2,3}\s*(?:.+?)\s*={2,3}\s*$"


def n_words(x):
    return f"(case when trim({x}, {WS}) = '' then 0 else len(regexp_split_to_array(trim({x}, {WS}), '\\s+')) end)"


share("v_sections", f"""
    select document_id, unnest(range(len(secs))) as section_no, unnest(secs) as section from (
      select document_id, case when len(found) > 0 then found else [content] end as secs from (
        select document_id, content, list_concat(
            case when trim(bodies[1], {WS}) <> '' then [trim(bodies[1], {WS})] else [] end,
            list_filter(list_transform(range(1, len(heads) + 1), lambda k:
                case when trim(bodies[k + 1], {WS}) <> '' then trim(heads[k], {WS}) || chr(10) || trim(bodies[k + 1], {WS}) end),
                lambda z: z is not null)) as found
        from (select document_id, content, regexp_split_to_array(content, '{HEAD_SPLIT}') as bodies,
                     regexp_extract_all(content, '{HEAD}', 1) as heads from v_text)))""")

share("v_titled", f"""
    select document_id, section_no, section_title, case when body = '' then section else body end as body from (
      select document_id, section_no, section, trim(split_part(trim(section, {WS}), chr(10), 1), {WS}) as section_title,
             case when strpos(trim(section, {WS}), chr(10)) > 0
                  then trim(substr(trim(section, {WS}), strpos(trim(section, {WS}), chr(10)) + 1), {WS})
                  else section end as body
      from v_sections)""")

SKIPPED = ", ".join(f"'{t}'" for t in [
    "see also", "references", "external links", "further reading", "notes", "bibliography", "footnotes",
    "citations", "sources", "works cited", "related articles", "navigation menu"])

share("v_labels", f"""
    select document_id, section_no, section_title, body,
           case when len(ns) = 0 then true when len(ns) < 3 then list_sum(ns) <= 4
                else len(list_filter(ns, lambda n: n <= 4)) / len(ns) > 0.6 end as is_label_list
    from (select *, list_transform(list_filter(list_transform(string_split(trim(body, {WS}), chr(10)),
                 lambda l: trim(l, {WS})), lambda l: l <> ''), lambda l: {n_words('l')}) as ns from v_titled)""")


def windows_sql(source, text, keys):
    return f"""
        select {keys}, unnest(range(cast(ceil(greatest(n - 400, 0) / 350) as bigint) + 1)) as window_no,
               unnest(case when n <= 400 then [{text}] else
                   list_transform(range(cast(ceil(greatest(n - 400, 0) / 350) as bigint) + 1),
                       lambda i: array_to_string(list_slice(ws, i * 350 + 1, i * 350 + 400), ' ')) end) as content
        from (select *, {n_words(text)} as n, regexp_split_to_array(trim({text}, {WS}), '\\s+') as ws from {source})"""


share("v_article_chunks", f"""
    select document_id, row_number() over (partition by document_id order by section_no, window_no) - 1 as sequence,
           section_title, content, {n_words('content')} as token_estimate
    from ({windows_sql('(select * from v_labels where not is_label_list and lower(section_title) not in (' + SKIPPED + '))',
                       'body', 'document_id, section_no, section_title')}) w
    where {n_words('content')} >= 80""")


@query("t01_split_sections", "select document_id, section_no, section from v_sections")
def split_sections(c):
    return K.section_rows(c.text)


@query("t02_section_titles", "select document_id, section_no, section_title, body from v_titled")
def section_titles(c):
    return K.titled_sections(c.text)


@query("t03_prose_sections", f"""select document_id, section_no, section_title from v_titled
    where lower(section_title) not in ({SKIPPED})""")
def prose_sections(c):
    return (K.titled_sections(c.text).where(~tx.is_skipped_section(F.col("section_title")))
            .select("document_id", "section_no", "section_title"))


@query("t04_label_lists", "select document_id, section_no, is_label_list from v_labels")
def label_lists(c):
    return K.titled_sections(c.text).select("document_id", "section_no",
                                            tx.is_label_list(F.col("body")).alias("is_label_list"))


@query("t05_word_windows", windows_sql("documents", "text", "doc_id"))
def word_windows(c):
    return (c.table("documents").select("doc_id", F.posexplode(K.windows(F.col("text")))
                                        .alias("window_no", "content")))


@query("t06_chunk_articles", "select document_id, sequence, section_title, content, token_estimate from v_article_chunks")
def chunk_articles(c):
    return K.chunk_articles(c.text).drop("chunk_id")


@query("t07_chunk_keys", """select document_id, sequence,
    sha256(cast(document_id as string) || ':' || cast(sequence as string)) as chunk_id from v_article_chunks""")
def chunk_keys(c):
    return K.chunk_articles(c.text).select("document_id", "sequence", "chunk_id")


share("v_risk_chunks", f"""
    select cik || '_' || period || '_1a_' || lpad(cast(pos as string), 4, '0') as chunk_id, 'item1a' as source,
           cik, period, trim(piece, {WS}) as text, pos
    from (select cik, period, unnest(range(len(cuts))) as pos,
                 unnest(list_transform(range(1, len(cuts) + 1), lambda k: array_to_string(list_slice(ls, cuts[k],
                     (case when k < len(cuts) then cuts[k + 1] - 1 else len(ls) end)), chr(10)))) as piece
          from (select cik, period, ls, list_concat([1], list_filter(range(2, len(ls) + 1), lambda p:
                    regexp_matches(chr(10) || array_to_string(list_slice(ls, p, len(ls)), chr(10)),
                        '^(\\n[A-Z][A-Z\\s,;:\\-.]{{10,}}\\n|\\nRisk Factor [0-9]+|\\n[•●]\\s)'))) as cuts
                from (select cik, period, string_split(item1a, chr(10)) as ls from v_filing_text)))
    where length(trim(piece, {WS})) >= 200""")

share("v_paragraph_chunks", f"""
    select cik || '_' || period || '_1_' || lpad(cast(pos as string), 4, '0') as chunk_id, 'item1' as source,
           cik, period, text, pos
    from (select cik, period, unnest(range(len(ps))) as pos, unnest(ps) as text from (
        select cik, period, list_filter(list_transform(string_split(item1, chr(10) || chr(10)),
            lambda p: trim(p, {WS})), lambda p: length(p) >= 200) as ps from v_filing_text))""")

share("v_filing_chunks", f"""
    select replace(c.chunk_id, c.period, left(replace(c.period, '-', ''), 6)) as chunk_id,
           c.cik || '_' || left(replace(c.period, '-', ''), 6) as document_id,
           row_number() over (partition by c.cik, c.period order by part, pos) - 1 as sequence,
           c.source as section_title, c.text as content, greatest(1, {n_words('c.text')}) as token_estimate,
           f.company as title, 'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || c.cik as url,
           case when not regexp_matches(sic, '^[0-9]+$') then 'finance'
                when cast(regexp_extract(sic, '[0-9]+') as int) between 6020 and 6099 then 'banking'
                when cast(regexp_extract(sic, '[0-9]+') as int) between 6141 and 6159 then 'banking'
                when cast(regexp_extract(sic, '[0-9]+') as int) between 6200 and 6211 then 'securities'
                when cast(regexp_extract(sic, '[0-9]+') as int) between 6311 and 6411 then 'insurance'
                else 'finance' end as domain, c.cik, left(replace(c.period, '-', ''), 6) as period
    from (select *, 0 as part from v_risk_chunks union all select *, 1 from v_paragraph_chunks) c
    join v_filing_text f on f.cik = c.cik and f.period = c.period""")


@query("t08_risk_factors", "select chunk_id, source, cik, period, text, length(text) as char_count from v_risk_chunks")
def risk_factors(c):
    return K.risk_factor_chunks(c.filing_text)


@query("t09_paragraphs", "select chunk_id, source, cik, period, text, length(text) as char_count from v_paragraph_chunks")
def paragraphs(c):
    return K.paragraph_chunks(c.filing_text)


@query("t10_filing_chunks", "select * from v_filing_chunks")
def filing_chunks(c):
    return K.common_chunks(c.filing_text)


@query("t11_period_keys", """select left(replace(period, '-', ''), 6) as period_key, count(*) as filings
    from v_filings group by 1""")
def period_keys(c):
    return c.filings.groupBy(tx.period_key(F.col("period")).alias("period_key")).agg(F.count("*").alias("filings"))


@query("t12_industry_domains", """select sic, case when sic = 'bank' then 'finance'
        when regexp_matches(sic, '^60[2-9]|^61[45]') then 'banking'
        when regexp_matches(sic, '^62') then 'securities'
        when regexp_matches(sic, '^63|^64') then 'insurance' else 'finance' end as domain, count(*) as filings
    from v_filings group by 1, 2""")
def industry_domains(c):
    return (c.filings.groupBy("sic", tx.industry_domain(F.col("sic")).alias("domain"))
            .agg(F.count("*").alias("filings")))


@query("t13_title_domains", """select document_id, case
        when regexp_matches(lower(title), 'capital|basel|tier|liquidity|risk-weighted') then 'banking'
        when regexp_matches(lower(title), 'sec|securities|mifid|fund|etf') then 'securities'
        when regexp_matches(lower(title), 'insurance|solvency') then 'insurance'
        when regexp_matches(lower(title), 'swap|derivative|option|futures') then 'derivatives'
        when regexp_matches(lower(title), 'gdpr|aml|kyc|fatca|pci|swift') then 'regulatory'
        when regexp_matches(lower(title), 'ifrs|gaap|accounting|fair value') then 'accounting'
        else 'finance' end as domain from v_docs""")
def title_domains(c):
    return c.docs.select("document_id", tx.title_domain(F.col("title")).alias("domain"))


@query("t14_map_categories", """select g.document_id, g.category, case
        when regexp_matches(lower(title), 'basel|aifmd|dodd|mifid|gdpr|sox|sarbanes|volcker|ifrs|directive|regulation|act') then 'regulatory'
        when regexp_matches(lower(title), 'risk|var|stress|concentration|operational|liquidity|credit|market') then 'risk'
        when regexp_matches(lower(title), 'capm|apt|black|scholes|arbitrage|portfolio|sharpe|markowitz') then 'financial_theory'
        when regexp_matches(lower(title), 'fund|swap|derivative|option|futures|bond|equity|etf|hedge') then 'products'
        else 'other' end as conflict_domain
    from v_category g join v_docs d using (document_id)""")
def map_categories(c):
    return c.docs.select("document_id", tx.map_category(F.col("title")).alias("category"),
                         tx.conflict_domain(F.col("title")).alias("conflict_domain"))


share("v_query_category", """select document_id, source_document, case
        when regexp_matches(lower(title), 'basel|dodd|mifid|aifmd|sarbanes|gdpr|volcker|regulation|directive|compliance|supervisory') then 'regulatory'
        when regexp_matches(lower(title), 'risk|var|stress|volatility|exposure|concentration|liquidity') then 'risk'
        when regexp_matches(lower(title), 'capm|apt|black-scholes|arbitrage|valuation|pricing|expected return|beta|factor model') then 'pricing'
        else 'product' end as category from v_docs""")


@query("t15_query_categories", "select document_id, category from v_query_category")
def query_categories(c):
    return c.docs.select("document_id", tx.query_category(F.col("title")).alias("category"))


@query("t16_negated_claims", r"""select assertion_id, claim_text from v_assertions
    where regexp_matches(claim_text, '(?i)(^|[^\pL\pN_])(not|no|prohibit[\pL\pN_]*|forbid[\pL\pN_]*)($|[^\pL\pN_])')""")
def negated_claims(c):
    return c.assertions.where(tx.is_negated(F.col("claim_text"))).select("assertion_id", "claim_text")


def _cue(words):
    return f"regexp_matches(t, '(?i)(^|[^\\pL\\pN_])({words})($|[^\\pL\\pN_])')"


# Claims of the test tables hold no cue words, so each gets one by its number.
CUES = ["must hold", "shall file", "unless exempt", "per section 4", "generally", "is designed to", "is",
        "required to report", "in most cases", "permitted"]
_picked = "(['" + "','".join(CUES) + "'])[assertion_id % 10 + 1]"
share("v_cued", f"select assertion_id, {_picked} || ' ' || claim_text as t from v_assertions")


def _cued(c):
    cue = F.get(F.array(*[F.lit(x) for x in CUES]), (F.col("assertion_id") % 10).cast("int"))
    return c.assertions.select("assertion_id", F.concat(cue, F.lit(" "), "claim_text").alias("t"))


@query("t17_discourse_roles", f"""select assertion_id, case
        when {_cue('unless|except|except when|provided that|does not apply when')} then 'rebuttal'
        when {_cue('per §|per section|under section|pursuant to|in accordance with')} then 'backing'
        when {_cue('must|shall|required to|prohibited from')} then 'warrant'
        when {_cue('under normal conditions|as applicable|where required|in most cases|generally')} then 'qualifier'
        else 'ground' end as discourse_role from v_cued""")
def discourse_roles(c):
    return _cued(c).select("assertion_id", annotate.discourse_role(F.col("t")).alias("discourse_role"))


@query("t18_validity_types", f"""select assertion_id, case
        when {_cue('must|shall|required|prohibited|permitted')} then 'normative'
        when {_cue('designed to|intended to|the purpose of|purpose of this policy')} then 'expressive'
        else 'constative' end as validity_claim_type from v_cued""")
def validity_types(c):
    return _cued(c).select("assertion_id", annotate.validity_type(F.col("t")).alias("validity_claim_type"))


_names = ", ".join(f"('{n}')" for n in annotate.REGULATION_NAMES)


@query("t19_regulation_mentions", f"""select document_id, name from
    (select document_id, lower(title || ' ' || content) as t from v_text) d, (values {_names}) g(name)
    where case when contains(t, lower(name))
               then regexp_matches(t, '(^|[^\\pL\\pN_])' || lower(name) || '($|[^\\pL\\pN_])') else false end""")
def regulation_mentions(c):
    text = F.concat("title", F.lit(" "), "content")
    return c.text.select("document_id", F.explode(annotate.regulation_mentions(text)).alias("name"))


_season = "case when not temporal_is_default then 'season=' || coalesce(temporal_season, 'None') end"
_country = "case when not geo_is_global then 'countries=[' || array_to_string(geo_countries, ', ') || ']' end"


@query("t20_scope_summaries", f"""select assertion_id,
        coalesce(nullif(concat_ws(', ', {_season}, {_country}, case when not org_is_universal then 'org-scoped' end), ''), 'universal') as scope_text,
        coalesce(nullif(concat_ws(', ', {_country}, {_season}), ''), 'universal') as short_scope_text
    from v_assertions""")
def scope_summaries(c):
    return c.assertions.select("assertion_id", summaries.scope_summary().alias("scope_text"),
                               summaries.scope_summary(False, False).alias("short_scope_text"))


@query("t21_truncations", """select doc_id, left(text, 3000) as chunk_text, left(text, 1000) as source_text,
        left(text, 500) as payload_text, left(text, 300) as evidence_text, left(text, 120) as short_text from documents""")
def truncations(c):
    return c.table("documents").select("doc_id", *[
        F.substring("text", 1, n).alias(name) for name, n in
        [("chunk_text", 3000), ("source_text", 1000), ("payload_text", 500), ("evidence_text", 300), ("short_text", 120)]])


@query("t22_token_estimates", f"""select doc_id, cast(floor(length(text) / 4) as bigint) as llm_tokens,
        {n_words('text')} * 5 as embedding_tokens from documents""")
def token_estimates(c):
    return c.table("documents").select("doc_id", tx.llm_tokens(F.col("text")).alias("llm_tokens"),
                                       tx.embedding_tokens(F.col("text")).alias("embedding_tokens"))


@query("t24_confidence_buckets", """select case when confidence is null then 'unknown' when confidence >= 0.9 then '0.90_1.00'
        when confidence >= 0.8 then '0.80_0.89' when confidence >= 0.7 then '0.70_0.79' else 'below_0.70' end as bucket,
        count(*) as relations from v_relations group by 1""")
def confidence_buckets(c):
    return (c.relations.groupBy(tx.confidence_bucket(F.col("confidence")).alias("bucket"))
            .agg(F.count("*").alias("relations")))


@query("t25_effect_labels", """select assertion_id, case when abs(confidence - object_value / 10) < 0.2 then 'negligible'
        when abs(confidence - object_value / 10) < 0.5 then 'small'
        when abs(confidence - object_value / 10) < 0.8 then 'medium' else 'large' end as label
    from v_assertions where object_value is not null""")
def effect_labels(c):
    d = F.col("confidence") - F.col("object_value") / 10
    return (c.assertions.where("object_value is not null")
            .select("assertion_id", tx.effect_label(d).alias("label")))
