"""Corpus views derived from the benchmark tables.

The tables carry no assertions, so the views compute them by arithmetic on
document and line numbers.  Each view is one SELECT that both Spark and the
checking database can run; ``Dialect`` holds the few spellings that differ.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from claimgraph import schemas as S
from claimgraph.session import spread_narrow


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def array(self, *items: str) -> str:
        body = ", ".join(items)
        return f"array({body})" if self.spark else f"[{body}]"

    def pick(self, names: list[str | None], expr: str) -> str:
        quoted = ["cast(null as string)" if n is None else f"'{n}'" for n in names]
        idx = f"({expr}) % {len(names)}"
        if self.spark:
            return f"element_at({self.array(*quoted)}, cast({idx} as int) + 1)"
        return f"({self.array(*quoted)})[{idx} + 1]"

    def div(self, a: str, b: int) -> str:
        return f"(({a}) div {b})" if self.spark else f"(({a}) // {b})"

    def compact(self, *items: str) -> str:
        if self.spark:
            return f"array_compact({self.array(*items)})"
        return f"list_filter({self.array(*items)}, lambda x: x is not null)"

    def days_after(self, start: str, days: str) -> str:
        if self.spark:
            return f"date_add(date'{start}', cast({days} as int))"
        return f"(date '{start}' + cast({days} as integer))"

    def split_lines(self, col: str) -> str:
        return f"split({col}, '\\n')" if self.spark else f"string_split({col}, chr(10))"

    def keep(self, arr: str, var: str, cond: str) -> str:
        if self.spark:
            return f"filter({arr}, {var} -> {cond})"
        return f"list_filter({arr}, lambda {var}: {cond})"

    def map_indexed(self, arr: str, expr: str) -> str:
        """``expr`` uses ``l`` for the item and ``i`` for its 0-based index."""
        if self.spark:
            return f"transform({arr}, (l, i) -> {expr})"
        body = re.sub(r"\bi\b", "(j - 1)", expr)
        return f"list_transform({arr}, lambda l, j: {body})"

    def join(self, arr: str, sep: str) -> str:
        if self.spark:
            return f"array_join({arr}, '{sep}')"
        return f"array_to_string({arr}, {_duck_text(sep)})"

    def newline(self, times: int = 1) -> str:
        return "'" + "\\n" * times + "'" if self.spark else " || ".join(["chr(10)"] * times)

    def array_size(self, arr: str) -> str:
        return f"size({arr})" if self.spark else f"len({arr})"


def _duck_text(sep: str) -> str:
    return " || ".join(["chr(10)"] * sep.count("\\n")) if sep else "''"


# Vocabularies the derived views draw from.
STATUSES = ["authoritative", "authoritative", "inferred", "contested", "authoritative", "derived",
            "authoritative", "inferred", "deprecated", "authoritative", "orphaned", "authoritative",
            "authoritative"]
SUBJECTS = ["capital ratio", "liquidity buffer", "disclosure duty", "credit limit", "trading desk",
            "audit trail", "margin call", "reporting date", "exposure cap", "client consent",
            "risk weight", "board approval"]
DOMAINS = ["banking", "securities", "insurance", "derivatives"]
SEASONS = [None, None, "winter", None, "summer", None, None]
COUNTRIES = ["US", "DE", "FR", "ES", "UK"]
ROLES = ["ground", "warrant", "claim", "backing", "ground", "rebuttal", "qualifier", "warrant",
         "unclassified"]
VALIDITY = ["constative", "normative", "constative", "constative", "normative", "expressive",
            "unclassified", "constative", "normative"]
TITLES = ["Basel III capital framework", "Credit risk model", "Hedge fund structures",
          "Black-Scholes pricing", "MiFID II directive", "Interest rate swap", "General ledger",
          "Solvency of insurance groups", "Fair value accounting", "Operational risk"]
SECTIONS = ["Overview", "Scope", "References", "Capital rules", "See also", "Exemptions"]
SICS = ["6020", "6021", "6022", "6035", "6099", "6141", "6153", "6200", "6211", "6311", "6411",
        "7372", "bank"]
HEADERS = ["CREDIT AND MARKET RISKS", "Risk Factor 7", "LIQUIDITY, FUNDING AND CAPITAL",
           "• Cyber"]
MODELS = ["gemini-1.5-flash", "gemini-1.5-pro", "text-embedding-004", "unpriced-model"]
EVAL_TYPES = ["normative", "constative", "mixed"]
AUTHORITIES = ["primary", "secondary", "commentary"]


def view_sql(d: Dialect) -> dict[str, str]:
    """All derived views, in dependency order."""
    pick, div = d.pick, d.div
    lines = d.keep(d.split_lines("text"), "x", "trim(x) <> ''")
    v: dict[str, str] = {}

    v["v_docs"] = f"""
        select doc_id as document_id,
               {pick(TITLES, 'doc_id * 7 + 3')} || ' ' || cast(doc_id as string) as title,
               source as source_document, lang,
               case lang when 'en' then 'banking' when 'fr' then 'securities'
                         when 'de' then 'insurance' else 'derivatives' end as domain,
               n_chars, {d.array_size(lines)} as n_lines
        from documents"""

    if d.spark:
        v["v_lines"] = f"""
            select doc_id, cast(line_no as bigint) as line_no, line, source
            from (select doc_id, source, posexplode({lines}) as (line_no, line) from documents)"""
    else:
        v["v_lines"] = f"""
            select doc_id, cast(unnest(range(len(ls))) as bigint) as line_no, unnest(ls) as line, source
            from (select doc_id, source, {lines} as ls from documents) where len(ls) > 0"""

    heading = (f"'== ' || {pick(SECTIONS, 'i + doc_id')} || ' =='")
    body = f"case when (i + 2) % 4 = 0 then {heading} || {d.newline()} || l else l end"
    v["v_text"] = f"""
        select doc_id as document_id, {pick(TITLES, 'doc_id * 7 + 3')} || ' ' || cast(doc_id as string) as title,
               'https://corpus.example/' || cast(doc_id as string) as url,
               {d.join(d.map_indexed(d.split_lines('text'), body), chr(92) + 'n')} as content
        from documents"""

    v["v_assertions"] = f"""
        select doc_id * 10000000 + line_no as assertion_id,
               doc_id * 10000000 + {div('line_no', 6)} as chunk_id,
               doc_id as document_id, line_no, trim(line) as claim_text,
               {pick(SUBJECTS, 'doc_id * 3 + line_no * 5')} as subject,
               {pick(S.PREDICATES, 'doc_id * 7 + line_no * 3')} as predicate_type,
               'object ' || cast((doc_id + line_no) % 40 as string) as object_text,
               case when (doc_id + line_no) % 3 = 0 then cast(null as double)
                    else cast((doc_id * 31 + line_no * 7) % 20 as double) / 2 end as object_value,
               trim(line) as source_text, source as source_document,
               {pick(AUTHORITIES, 'doc_id')} as authority_level,
               {pick(STATUSES, 'doc_id * 5 + line_no * 11')} as epistemic_status,
               cast(50 + (doc_id * 13 + line_no * 17) % 51 as double) / 100 as confidence,
               {pick(DOMAINS, 'doc_id * 11 + line_no')} as domain,
               {pick(ROLES, 'doc_id * 2 + line_no * 7')} as discourse_role,
               {pick(VALIDITY, 'doc_id * 5 + line_no * 4')} as validity_claim_type,
               {d.compact(
                   "case when (doc_id + line_no) % 2 = 0 then 'topic_' || cast((doc_id * 3 + line_no) % 31 as string) end",
                   "case when (doc_id + line_no) % 7 = 0 then 'topic_' || cast((doc_id + line_no * 5) % 31 as string) end")} as topics,
               {d.compact(
                   "case when (doc_id + line_no) % 11 = 0 then '' else 'concept_' || cast("
                   + div('doc_id', 3) + " * 4 + line_no % 4 as string) end",
                   "case when doc_id % 3 = 0 then 'hub_' || cast(line_no % 5 as string) end")} as entities,
               {d.compact(
                   "case when (doc_id + 2 * line_no) % 4 = 0 then 'REG-' || cast("
                   + div('((doc_id * 5 + line_no * 3) % 23) * ((doc_id * 5 + line_no * 3) % 23)', 40) + " as string) end",
                   "case when (doc_id + line_no) % 12 = 0 then 'REG-' || cast((doc_id + line_no * 3) % 17 as string) end")} as regulations,
               {pick(SEASONS, 'doc_id + line_no * 2')} as temporal_season,
               (doc_id + line_no * 2) % 7 not in (2, 4) as temporal_is_default,
               (doc_id * 3 + line_no) % 4 <> 0 as geo_is_global,
               {d.array(pick(COUNTRIES, 'doc_id + line_no'))} as geo_countries,
               (doc_id + line_no * 3) % 5 <> 0 as org_is_universal,
               {pick(S.COVERAGES, 'doc_id + line_no * 3')} as scope_coverage,
               {d.days_after('2015-01-01', '(doc_id * 3 + line_no) % 3000')} as effective_date,
               {d.days_after('2016-01-01', '(doc_id * 3 + line_no * 7) % 3000')} as expiry_date
        from v_lines"""

    v["v_chunks"] = f"""
        select distinct doc_id * 10000000 + {div('line_no', 6)} as chunk_id, doc_id as document_id,
               {div('line_no', 6)} as sequence
        from v_lines"""

    # Every vector of the table is drawn from, however many there are.
    n_vectors = "greatest((select count(*) from embeddings), 1)"
    v["v_vector_parts"] = f"""
        select chunk_id, document_id, document_id % {n_vectors} as base_id,
               (document_id * 7 + 11 * {div('document_id', 100)} + 3 + 13 * sequence) % {n_vectors} as noise_id
        from v_chunks"""
    v["v_queries"] = f"""
        select query_id, query_text, epistemic_type, embedding as vector
        from (select item_id as query_id, text as query_text, {pick(EVAL_TYPES, 'item_id')} as epistemic_type,
                     item_id % {n_vectors} as base_id from benchmark) q
        join embeddings on vec_id = base_id"""
    if d.spark:
        mixed = "zip_with(b.embedding, n.embedding, (x, y) -> cast(x as double) + 0.47D * cast(y as double))"
        # Lambdas over arrays of one item: the mixture and its length are computed once a vector, not once an entry.
        length = "sqrt(aggregate(raw, 0D, (s, y) -> s + y * y))"
        unit = f"transform(array({mixed}), raw -> transform(array({length}), l -> transform(raw, x -> cast(x / l as float)))[0])[0]"
        v["v_vectors"] = f"""
            select c.chunk_id, c.document_id, {unit} as vector
            from v_vector_parts c join embeddings b on b.vec_id = c.base_id join embeddings n on n.vec_id = c.noise_id"""
    else:
        v["v_vectors"] = """
            select chunk_id, document_id,
                   list_transform(raw, lambda x: cast(x / sqrt(list_dot_product(raw, raw)) as float)) as vector
            from (select c.chunk_id, c.document_id,
                         list_transform(range(1, 65), lambda k:
                             cast(b.embedding[k] as double) + cast(0.47 as double) * cast(n.embedding[k] as double)) as raw
                  from v_vector_parts c join embeddings b on b.vec_id = c.base_id join embeddings n on n.vec_id = c.noise_id)"""

    block = div("doc_id", 50) + " * 50"
    near = f"case when (doc_id + line_no) % 3 = 0 then doc_id + 100 else {block} + (doc_id * 37 + line_no * 101 + 11) % 50 end"
    if d.spark:
        # One pass: a line gives its edges of all families, and its document's line count is at hand.
        families = f"""
            select doc_id, line_no, doc_id * 10000000 + line_no as src, e.fam as fam, e.tdoc as tdoc, e.tkey as tkey
            from (select doc_id, line_no, explode(array_compact(array(
                      named_struct('fam', 0, 'tdoc', {near}, 'tkey', line_no * 7 + 3),
                      case when line_no + 1 < own_lines then named_struct('fam', 1, 'tdoc', doc_id, 'tkey', line_no + 1) end,
                      case when (doc_id + line_no) % 5 = 0 then named_struct('fam', 2, 'tdoc', {near}, 'tkey', line_no * 7 + 3) end,
                      case when (doc_id + line_no) % 15 = 0 then named_struct('fam', 3, 'tdoc', {near}, 'tkey', line_no * 7 + 3) end))) as e
                  from (select doc_id, own_lines, cast(p as bigint) as line_no
                        from (select doc_id, size(ls) as own_lines, posexplode(ls) as (p, line)
                              from (select doc_id, {lines} as ls from documents))))"""
    else:
        families = f"""
            select doc_id, line_no, 0 as fam, doc_id * 10000000 + line_no as src, {near} as tdoc, line_no * 7 + 3 as tkey
            from v_lines
            union all
            select l.doc_id, l.line_no, 1, l.doc_id * 10000000 + l.line_no, l.doc_id, l.line_no + 1
            from v_lines l join v_docs n on n.document_id = l.doc_id where l.line_no + 1 < n.n_lines
            union all
            select doc_id, line_no, 2, doc_id * 10000000 + line_no, {near}, line_no * 7 + 3
            from v_lines where (doc_id + line_no) % 5 = 0
            union all
            select doc_id, line_no, 3, doc_id * 10000000 + line_no, {near}, line_no * 7 + 3
            from v_lines where (doc_id + line_no) % 15 = 0"""
    v["v_relations"] = f"""
        select relationship_id, source_assertion_id, target_assertion_id, relation_type, confidence,
               relation_type in ({_quoted(S.TRUTH_PRESERVING)}) as is_truth_preserving,
               relation_type in ({_quoted(S.DEFEASIBLE)}) as is_defeasible,
               relation_type in ({_quoted(S.BIDIRECTIONAL)}) as is_bidirectional,
               evidence_text, mechanism, strength
        from (
            select src * 4 + fam as relationship_id, src as source_assertion_id,
                   case when (doc_id + line_no) % 41 = 0 and fam = 0 then -src - 1
                        else tdoc * 10000000 + tkey % n_lines end as target_assertion_id,
                   {pick(S.RELATION_TYPES, 'doc_id * 3 + line_no * 5 + case when fam = 3 then 0 else fam end * 7')} as relation_type,
                   case when src % 23 = 0 then cast(null as double) when src % 29 = 0 then cast(0 as double)
                        else cast(50 + (doc_id * 7 + line_no * 11 + fam * 3) % 51 as double) / 100 end as confidence,
                   'evidence ' || cast(src as string) as evidence_text,
                   case when src % 3 = 0 then 'mechanism ' || cast(src % 7 as string) end as mechanism,
                   {pick(['strong', 'moderate', 'weak', None], 'doc_id + line_no')} as strength
            from ({families}) f join v_docs t on t.document_id = f.tdoc where n_lines > 0)
        where source_assertion_id <> target_assertion_id"""

    partner = (f"case when (doc_id + line_no) % 2 = 0 then doc_id + 100 "
               f"else {block} + (doc_id * 53 + line_no * 7 + 7) % 50 end")
    v["v_conflicts"] = f"""
        select relationship_id, source_assertion_id, target_assertion_id, relationship_type,
               confidence, review_status, explanation, created_day
        from (
            select src as relationship_id, src as source_assertion_id,
                   tdoc * 10000000 + (line_no * 5 + 1) % n_lines as target_assertion_id,
                   {pick(S.CONFLICT_TYPES + ['CONTRADICTS', 'CONTRADICTS'], 'doc_id * 3 + line_no')} as relationship_type,
                   case when src % 31 = 0 then cast(null as double)
                        else cast(60 + (doc_id * 3 + line_no * 7) % 41 as double) / 100 end as confidence,
                   {pick(['pending', 'validated', 'false_positive', 'deferred'], 'doc_id + line_no * 3')} as review_status,
                   'pair ' || cast(src as string) as explanation,
                   (doc_id * 17 + line_no) % 365 as created_day
            from (select doc_id, line_no, doc_id * 10000000 + line_no as src, {partner} as tdoc from v_lines
                  where (doc_id * 7 + line_no * 3) % 13 = 0) c
            join v_docs t on t.document_id = c.tdoc where n_lines > 0)
        where source_assertion_id <> target_assertion_id"""

    v["v_conflict_items"] = """
        select relationship_id * 10 + 1 as conflict_id, relationship_id,
               case relationship_type when 'CONTRADICTS' then 1 when 'SUPERSEDES' then 2
                    when 'SPECIALIZES' then 3 when 'DUPLICATE' then 4 else 5 end as priority,
               created_day
        from v_conflicts where relationship_type not in ('FALSE_POSITIVE', 'COMPLEMENTARY')"""

    v["v_filings"] = f"""
        select cast(o_custkey as string) as cik, 'Firm ' || cast(o_custkey as string) as company,
               {pick(SICS, 'o_orderkey')} as sic,
               substr(cast(o_orderdate as string), 1, 10) as filing_date,
               '000-' || cast(o_orderkey as string) as accession_no,
               substr(cast(o_orderdate as string), 1, 7) as period
        from orders"""

    risk = (f"case when i % 3 = 1 then {pick(HEADERS, 'i + doc_id')} || {d.newline()} || l else l end")
    v["v_filing_text"] = f"""
        select cast(doc_id as string) as cik, 'Firm ' || cast(doc_id as string) as company,
               {pick(SICS, 'doc_id')} as sic, '2023-0' || cast(doc_id % 9 + 1 as string) as period,
               case when doc_id % 17 = 0 then '' else {d.join(d.split_lines('text'), chr(92) + 'n' + chr(92) + 'n')} end as item1,
               case when doc_id % 13 = 0 then '' when doc_id % 19 = 0 then '  '
                    else case when doc_id % 4 = 0 then {d.newline()} else '' end
                         || {d.join(d.map_indexed(d.split_lines('text'), risk), chr(92) + 'n')} end as item1a
        from documents"""

    v["v_costs"] = f"""
        select event_id as record_id, ts, {pick(MODELS, 'user_id')} as model, event_type as stage,
               cast(floor(value * 100) as bigint) as input_tokens,
               cast(floor(value * 20) as bigint) as output_tokens
        from events"""
    return v


def _quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


BASE_TABLES = ["documents", "embeddings", "benchmark", "orders", "events"]
SPARK_VIEWS = view_sql(Dialect(spark=True))
CHECK_VIEWS = view_sql(Dialect(spark=False))


def _needed(sql: str, views: dict[str, str]) -> list[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in views:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(views[name])
    return [name for name in views if name in found]


class Corpus:
    """Lazily built DataFrames over one data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread_narrow(rows, "doc_id") if name == "documents" else rows

    def view(self, name: str) -> DataFrame:
        needed = _needed(f" {name} ", SPARK_VIEWS)
        ctes = ",\n".join(f"{n} as ({SPARK_VIEWS[n]})" for n in needed)
        sql = f"with {ctes} select * from {name}"
        used = {t: self.table(t) for t in BASE_TABLES if re.search(rf"\b(from|join) {t}\b", sql)}
        for t in used:
            sql = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", sql)
        return self.spark.sql(_escape_braces(sql, used), **used)

    docs = cached_property(lambda self: self.view("v_docs"))
    lines = cached_property(lambda self: self.view("v_lines"))
    text = cached_property(lambda self: self.view("v_text"))
    assertions = cached_property(lambda self: self.view("v_assertions"))
    chunks = cached_property(lambda self: self.view("v_chunks"))
    vectors = cached_property(lambda self: self.view("v_vectors"))
    queries = cached_property(lambda self: self.view("v_queries"))
    relations = cached_property(lambda self: self.view("v_relations"))
    conflicts = cached_property(lambda self: self.view("v_conflicts"))
    conflict_items = cached_property(lambda self: self.view("v_conflict_items"))
    filings = cached_property(lambda self: self.view("v_filings"))
    filing_text = cached_property(lambda self: self.view("v_filing_text"))
    costs = cached_property(lambda self: self.view("v_costs"))


def _escape_braces(sql: str, used: dict) -> str:
    """``spark.sql`` formats ``{name}``; only the table slots may keep their braces."""
    marked = re.sub(r"\{(" + "|".join(used) + r")\}", "\u0001\\1\u0002", sql)
    return marked.replace("{", "{{").replace("}", "}}").replace("\u0001", "{").replace("\u0002", "}")
