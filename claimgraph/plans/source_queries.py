"""Readers, writers, keyed tables and response parsers, run on derived rows."""

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph import schemas as S
from claimgraph.functions import annotate
from claimgraph.functions import scope as sc
from claimgraph.operators import chunking as K
from claimgraph.operators.retrieval import neutral_seeds
from claimgraph.plans.registry import query, share
from claimgraph.plans.stored import found
from claimgraph.sources import files, responses, tables


def _array_text(values, kind="string"):
    return F.array(*[F.lit(v) for v in values]).cast(f"array<{kind}>")


def articles(c):
    return c.text.select("title", "url", "content", F.size(F.split("content", " ")).alias("word_count"),
                         F.timestamp_seconds(F.lit(1704067200) + F.col("document_id")).alias("fetched_at"),
                         F.lit("finance").alias("domain"))


@query("s01_read_articles", """select title, url, content, len(string_split(content, ' ')) as word_count,
    1704067200 + document_id as fetched_at from v_text""")
def read_articles(c):
    path = files.scratch_folder(c.spark)
    files.write_json(articles(c), path)
    return (files.read_articles(c.spark, path, one_per_line=True).where("title is not null")
            .select("title", "url", "content", "word_count",
                    F.unix_timestamp("fetched_at").alias("fetched_at")))


@query("s02_read_chunks", """select document_id, sequence, section_title, content, token_estimate from
    (select cast(document_id as string) as document_id, * exclude (document_id) from v_article_chunks)""")
def read_chunks(c):
    path = files.scratch_folder(c.spark)
    chunks = K.chunk_articles(c.text).withColumn("document_id", F.col("document_id").cast("string"))
    files.write_json(chunks, path)
    return (files.read_chunks(c.spark, path, one_per_line=True)
            .select("document_id", "sequence", "section_title", "content", "token_estimate"))


def nested_assertions(c):
    """Derived assertions with their scope as a nested struct and text ids."""
    scope = F.to_json(F.struct(
        F.struct(F.col("temporal_season").alias("season"), F.col("temporal_is_default").alias("is_default")).alias("temporal"),
        F.struct(F.col("geo_countries").alias("countries"), F.col("geo_is_global").alias("is_global")).alias("geographic"),
        F.struct(F.col("org_is_universal").alias("is_universal")).alias("organizational"),
        F.col("scope_coverage").alias("coverage")))
    own = {f.name: f.dataType for f in S.ASSERTION.fields}
    rows = c.assertions.withColumn("scope", sc.from_text(scope))
    return rows.select(*[F.col(n).cast(t) if t.simpleString() == "string" else F.col(n)
                         for n, t in own.items() if n in rows.columns])


@query("s03_read_assertions", """select cast(assertion_id as string) as assertion_id, claim_text, confidence,
        array_to_string(topics, '|') as topics, temporal_season as season, temporal_is_default as is_default,
        array_to_string(geo_countries, '|') as countries, scope_coverage as coverage
    from v_assertions""")
def read_assertions(c):
    path = files.scratch_folder(c.spark)
    files.write_json(nested_assertions(c), path)
    return files.read_assertions(c.spark, path, one_per_line=True).select(
        "assertion_id", "claim_text", "confidence", F.array_join("topics", "|").alias("topics"),
        "scope.temporal.season", "scope.temporal.is_default",
        F.array_join("scope.geographic.countries", "|").alias("countries"), "scope.coverage")


# Grammar entries: three of four assertions, one in nine with a role outside the enumeration.
_grammar = """select assertion_id, case when assertion_id % 9 = 0 then 'expressive'
        when assertion_id % 9 = 1 then null
        else (['warrant','ground','claim','backing'])[assertion_id % 4 + 1] end as discourse_role,
        (['normative','constative','expressive'])[assertion_id % 3 + 1] as validity_claim_type
    from v_assertions where assertion_id % 4 <> 0"""
share("v_grammar", _grammar)


def grammar(c):
    i = F.col("assertion_id")
    role = (F.when(i % 9 == 0, "expressive").when(i % 9 == 1, None)
            .otherwise(F.get(_array_text(["warrant", "ground", "claim", "backing"]), (i % 4).cast("int"))))
    kind = F.get(_array_text(["normative", "constative", "expressive"]), (i % 3).cast("int"))
    return (c.assertions.where(i % 4 != 0)
            .select("document_id", "assertion_id", role.alias("discourse_role"), kind.alias("validity_claim_type")))


@query("s04_read_grammar_maps", """select cast(assertion_id as string) as assertion_id, discourse_role, validity_claim_type from v_grammar""")
def read_grammar(c):
    path = files.scratch_folder(c.spark)
    entry = F.struct(F.col("assertion_id").cast("string").alias("assertion_id"), "discourse_role", "validity_claim_type")
    # One map per line here; a map file of its own per document in the field.
    maps = (grammar(c).withColumn("part", F.floor(F.col("assertion_id") / 1000))
            .groupBy("document_id", "part")
            .agg(F.map_from_entries(F.collect_list(F.struct(F.col("assertion_id").cast("string"), entry))).alias("m"))
            .select(F.to_json("m").alias("value")))
    maps.write.mode("overwrite").text(path)
    lines = c.spark.read.text(path)
    return files.explode_grammar(lines, F.from_json("value", T.MapType(T.StringType(), S.GRAMMAR_ENTRY)))


@query("s05_read_relations", """select cast(relationship_id as string) as relationship_id, cast(source_assertion_id as string) as source_assertion_id,
    cast(target_assertion_id as string) as target_assertion_id, relation_type, is_truth_preserving, is_defeasible,
    is_bidirectional, evidence_text, confidence from v_relations""")
def read_relations(c):
    path = files.scratch_folder(c.spark)
    rows = c.relations.select(*[F.col(x).cast("string") if x.endswith("_id") else F.col(x) for x in c.relations.columns])
    files.write_json(rows, path)
    return files.read_relations(c.spark, path, one_per_line=True).select(
        "relationship_id", "source_assertion_id", "target_assertion_id", "relation_type", "is_truth_preserving",
        "is_defeasible", "is_bidirectional", "evidence_text", "confidence")


@query("s06_vector_files", """select chunk_id, document_id, len(vector) as dims,
    round(list_dot_product(list_transform(vector, lambda x: cast(x as double)), list_transform(range(1, 65), lambda k: cast(k as double))), 5) as weighted
    from v_vectors""")
def vector_files(c):
    path = files.scratch_folder(c.spark)
    files.write_vectors(c.vectors, path)
    weighted = F.aggregate(F.transform("vector", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return files.read_vectors(c.spark, path).select("chunk_id", "document_id", F.size("vector").alias("dims"),
                                                    F.round(weighted, 5).alias("weighted"))


@query("s07_filing_index_csv", "select cik, company, sic, filing_date, accession_no, period from v_filings")
def filing_index_csv(c):
    path = files.scratch_folder(c.spark)
    files.write_filing_index(c.filings, path)
    return files.read_filing_index(c.spark, path)


@query("s08_manifest", """select document_id as doc_id, count(*) as chunk_count,
        string_agg(chunk_id, '|' order by sequence) as chunk_ids, cast(sum(length(content)) as bigint) as chars,
        any_value(cik) as cik from v_filing_chunks group by 1""")
def manifest(c):
    rows = files.manifest(K.common_chunks(c.filing_text), "filings")
    path = files.scratch_folder(c.spark)
    files.write_json(rows, path)
    back = c.spark.read.schema(rows.schema).json(path)
    return back.select("doc_id", "chunk_count", F.array_join("chunks.chunk_id", "|").alias("chunk_ids"),
                       F.aggregate("chunks.char_count", F.lit(0).cast("bigint"), lambda s, n: s + n).alias("chars"),
                       "metadata.cik")


@query("s10_keyed_insert", """select min(relationship_id) as relationship_id, source_assertion_id, target_assertion_id
    from v_relations r where not exists (select 1 from v_conflicts k where k.source_assertion_id = r.source_assertion_id
                                           and k.target_assertion_id = r.target_assertion_id)
    group by source_assertion_id, target_assertion_id""")
def keyed_insert(c):
    key = ["source_assertion_id", "target_assertion_id"]
    return (tables.new_rows(c.relations, c.conflicts, key, [F.col("relationship_id")])
            .select("relationship_id", *key))


@query("s11_keyed_update", """select relationship_id, relationship_type, case when priority = 1 then 'validated' else review_status end as review_status
    from v_conflicts left join v_conflict_items using (relationship_id)""")
def keyed_update(c):
    updates = (c.conflict_items.where("priority = 1")
               .select("relationship_id", F.lit("validated").alias("review_status")))
    return (tables.update_column(c.conflicts, updates, "relationship_id", "review_status")
            .select("relationship_id", "relationship_type", "review_status"))


@query("s13_partitioned_results", """select relation_type, count(*) as n, round(sum(coalesce(confidence, 0)), 4) as total
    from v_relations group by 1""")
def partitioned_results(c):
    path = files.scratch_folder(c.spark)
    files.write_json(c.relations.select("relation_type", "relationship_id", "confidence"), path, "relation_type")
    back = c.spark.read.schema("relation_type string, relationship_id bigint, confidence double").json(path)
    return back.groupBy("relation_type").agg(F.count("*").alias("n"),
                                             F.round(F.sum(F.coalesce("confidence", F.lit(0))), 4).alias("total"))


# ---- extractor responses ---------------------------------------------------------------------

def _fenced(text, key):
    """Every second response comes inside a code fence; every 37th is cut off."""
    fenced = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    return F.when(key % 37 == 5, F.left(text, F.length(text) - 1)).when(key % 2 == 0, fenced).otherwise(text)


def assertion_responses(c):
    i = F.col("assertion_id")
    item = F.to_json(F.struct(
        F.when(i % 13 != 0, F.col("claim_text")).alias("claim_text"), "subject",
        F.when(i % 5 == 0, "invents").otherwise(F.col("predicate_type")).alias("predicate_type"),
        F.when(i % 7 != 0, F.col("confidence")).alias("confidence"), F.col("object_value").alias("object_value"),
        F.when(i % 3 == 0, "conditional").when(i % 3 == 1, "sometimes").otherwise(F.col("scope_coverage")).alias("scope_coverage"),
        F.when(i % 4 != 0, F.col("topics")).alias("topics"),
        F.struct(F.struct(F.col("temporal_season").alias("season"), F.col("temporal_is_default").alias("is_default"))
                 .alias("temporal")).alias("scope")))
    element = F.when(i % 11 == 0, F.lit('"stray text"')).when(i % 11 == 1, F.lit("42")).otherwise(item)
    # A chunk holds at most six derived assertions.
    return (c.assertions.withColumn("element", element).groupBy("chunk_id", "document_id")
            .agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), "element"))).alias("es"))
            .select("chunk_id", "document_id", F.lit("doc").alias("doc_title"), _fenced(
                F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["element"]), ", "), F.lit("]")),
                F.col("chunk_id")).alias("raw")))


share("v_ok_chunks", "select chunk_id from v_chunks where chunk_id % 37 <> 5")


@query("s14_parse_assertions", """select chunk_id, row_number() over (partition by chunk_id order by assertion_id) - 1 as ord, * exclude (chunk_id, assertion_id) from (
        select chunk_id, assertion_id, case when assertion_id % 13 <> 0 then claim_text else '' end as claim_text,
            case when assertion_id % 5 = 0 then 'relates_to' else predicate_type end as predicate_type,
            case when assertion_id % 7 <> 0 then confidence else 0.8 end as confidence,
            coalesce(object_value, -1) as object_value,
            case when assertion_id % 3 = 0 then 'conditional_override' when assertion_id % 3 = 1 then 'universal' else scope_coverage end as coverage,
            case when assertion_id % 4 <> 0 then array_to_string(topics, '|') else '' end as topics,
            coalesce(temporal_season, 'none') as season, temporal_is_default as is_default
        from v_assertions where chunk_id in (select chunk_id from v_ok_chunks) and assertion_id % 11 > 1)""")
def parse_assertions(c):
    rows = responses.parse_assertions(assertion_responses(c))
    before = F.row_number().over(Window.partitionBy("chunk_id").orderBy("pos")) - 1
    return rows.select("chunk_id", before.alias("ord"), "claim_text", "predicate_type", "confidence",
                       F.coalesce("object_value", F.lit(-1.0)).alias("object_value"), "scope.coverage",
                       F.array_join("topics", "|").alias("topics"),
                       F.coalesce("scope.temporal.season", F.lit("none")).alias("season"), "scope.temporal.is_default")


@query("s14_failed_responses", "select chunk_id from v_chunks where chunk_id % 37 = 5")
def failed_responses(c):
    return responses.failed_responses(assertion_responses(c)).select("chunk_id")


def relation_responses(c):
    r = F.col("relationship_id")
    item = F.to_json(F.struct(
        F.col("source_assertion_id").cast("string").alias("source_assertion_id"),
        F.col("target_assertion_id").cast("string").alias("target_assertion_id"),
        F.when(r % 10 == 0, "RESEMBLES").otherwise(F.col("relation_type")).alias("relation_type"),
        F.when(r % 4 == 0, F.lit(False)).alias("is_truth_preserving"), F.col("confidence")))
    element = F.when(r % 12 == 1, F.lit("null")).otherwise(item)
    # One response per source assertion: at most four derived relations.
    return (c.relations.withColumn("element", element).groupBy(F.col("source_assertion_id").alias("document_id"))
            .agg(F.array_sort(F.collect_list(F.struct(r.alias("r"), "element"))).alias("es"))
            .select("document_id", _fenced(
                F.concat(F.lit("["), F.array_join(F.transform("es", lambda e: e["element"]), ","), F.lit("]")),
                F.col("document_id")).alias("raw")))


@query("s15_parse_relations", """select source_assertion_id as document_id, cast(target_assertion_id as string) as target_assertion_id, relation_type,
        case when relationship_id % 4 = 0 then false else is_truth_preserving end as is_truth_preserving,
        is_defeasible, is_bidirectional, coalesce(confidence, 0.8) as confidence
    from v_relations where relationship_id % 10 <> 0 and relationship_id % 12 <> 1 and source_assertion_id % 37 <> 5""")
def parse_relations(c):
    return responses.parse_relations(relation_responses(c)).select(
        "document_id", "target_assertion_id", "relation_type", "is_truth_preserving", "is_defeasible",
        "is_bidirectional", "confidence")


@query("s16_parse_grammar", """select a.document_id, cast(g.assertion_id as string) as assertion_id,
        case when g.assertion_id % 6 = 0 then 'rebuttal' else coalesce(g.discourse_role, '-') end as discourse_role,
        g.validity_claim_type
    from v_grammar g join v_assertions a on a.assertion_id = g.assertion_id
    where g.assertion_id % 14 <> 3 and a.chunk_id % 37 <> 5""")
def parse_grammar(c):
    i = F.col("assertion_id")
    text_id = F.when(i % 14 != 3, i.cast("string"))
    item = F.to_json(F.struct(text_id.alias("assertion_id"), "discourse_role", "validity_claim_type"))
    # A sixth of the ids comes twice; the second mention counts.
    again = F.to_json(F.struct(text_id.alias("assertion_id"), F.lit("rebuttal").alias("discourse_role"), "validity_claim_type"))
    element = F.when(i % 6 == 0, F.concat(item, F.lit(","), again)).otherwise(item)
    raw = (grammar(c).withColumn("element", element)
           .withColumn("chunk_id", F.col("document_id") * 10000000 + F.floor((i % 10000000) / 6))
           .groupBy("chunk_id", "document_id").agg(F.array_sort(F.collect_list(F.struct(i.alias("i"), "element"))).alias("es"))
           .select("document_id", _fenced(F.concat(
               F.lit('{"classifications": ['), F.array_join(F.transform("es", lambda e: e["element"]), ","), F.lit("]}")),
               F.col("chunk_id")).alias("raw")))
    return (responses.parse_grammar(raw).withColumn("discourse_role", F.coalesce("discourse_role", F.lit("-"))))


@query("s17_parse_adjudications", """select source_assertion_id as assertion_id_a, target_assertion_id as assertion_id_b,
        case when relationship_id % 5 = 0 then 'FALSE_POSITIVE' else relationship_type end as relationship_type,
        coalesce(confidence, 0.8) as confidence, explanation, 'overlaps' as overlap_temporal, 'unknown' as overlap_geographic
    from v_conflicts where source_assertion_id % 37 <> 5""")
def parse_adjudications(c):
    r = F.col("relationship_id")
    item = F.to_json(F.struct(F.when(r % 5 != 0, F.col("relationship_type")).alias("relationship_type"), "confidence",
                              "explanation", F.struct(F.lit("overlaps").alias("temporal")).alias("scope_overlap")))
    text = F.when(r % 3 == 0, F.concat(F.lit("["), item, F.lit(', {"relationship_type": "DUPLICATE"}]'))).otherwise(item)
    raw = c.conflicts.select(F.col("source_assertion_id").alias("assertion_id_a"),
                             F.col("target_assertion_id").alias("assertion_id_b"),
                             _fenced(text, F.col("source_assertion_id")).alias("raw"))
    return responses.parse_adjudications(raw).select(
        "assertion_id_a", "assertion_id_b", "relationship_type", "confidence", "explanation",
        "overlap_temporal", "overlap_geographic")


@query("t26_scope_round_trip", """select assertion_id, coalesce(temporal_season, 'none') as season, temporal_is_default as is_default,
        array_to_string(geo_countries, '|') as countries, geo_is_global as is_global, org_is_universal as is_universal,
        scope_coverage as coverage, 'unknown' as completeness, cast(0 as bigint) as n_conditions from v_assertions""")
def scope_round_trip(c):
    nested = nested_assertions(c).withColumn("scope", sc.from_text(sc.to_text(F.col("scope"))))
    return nested.select(F.col("assertion_id").cast("bigint").alias("assertion_id"),
                         F.coalesce("scope.temporal.season", F.lit("none")).alias("season"),
                         "scope.temporal.is_default", F.array_join("scope.geographic.countries", "|").alias("countries"),
                         "scope.geographic.is_global", "scope.organizational.is_universal", "scope.coverage",
                         "scope.completeness", F.size("scope.conditional.conditions").alias("n_conditions"))


@query("t27_flat_scope", """select assertion_id, coalesce(temporal_season, 'none') as temporal_season, temporal_is_default,
        array_to_string(geo_countries, '|') as geo_countries, geo_is_global, org_is_universal, scope_coverage,
        'unknown' as scope_source from v_assertions""")
def flat_scope(c):
    flat = nested_assertions(c).select(F.col("assertion_id").cast("bigint").alias("assertion_id"), *sc.flat_columns())
    return flat.select("assertion_id", F.coalesce("temporal_season", F.lit("none")).alias("temporal_season"),
                       "temporal_is_default", F.array_join("geo_countries", "|").alias("geo_countries"),
                       "geo_is_global", "org_is_universal", "scope_coverage", "scope_source")


@query("s09_gazetteer_mentions", """select name, count(*) as documents from (
        select document_id, name from (select document_id, lower(title) as t from v_docs) d,
            (select unnest(['Basel III', 'Basel II', 'Basel I', 'MiFID', 'MiFID II', 'Solvency II', 'SEC', 'CRA']) as name) g
        where case when contains(t, lower(name)) then regexp_matches(t, '(^|[^\\pL\\pN_])' || lower(name) || '($|[^\\pL\\pN_])') else false end) group by 1""")
def gazetteer_mentions(c):
    named = c.docs.select("document_id", F.explode(annotate.regulation_mentions(F.col("title"))).alias("name"))
    return named.groupBy("name").agg(F.count("*").alias("documents"))


_gazetteer_sql = "select name, count(*) as documents from (" + """
        select document_id, name from (select document_id, lower(content) as t from v_text) d,
            (select unnest(['Basel III', 'MiFID II', 'Overview', 'Capital rules', 'See also', 'der', 'of the', 'en un', 'le', 'rules =='])
             as name) g
        where case when contains(t, lower(name)) then regexp_matches(t, '(^|[^\\pL\\pN_])' || lower(name) || '($|[^\\pL\\pN_])') else false end) group by 1"""


@query("s09_gazetteer_file", _gazetteer_sql)
def gazetteer_file(c):
    names = ["Basel III", "MiFID II", "Overview", "Capital rules", "See also", "der", "of the", "en un", "le", "rules =="]
    path = files.scratch_folder(c.spark)
    files.write_gazetteer(c.spark.createDataFrame([(n,) for n in names], "name string"), path)
    found = annotate.table_mentions(c.text, files.read_gazetteer(c.spark, path), "document_id", "content")
    return found.groupBy("name").agg(F.count("*").alias("documents"))


@query("s12_queries_with_seeds", """select cast(query_id as string) as query_id, epistemic_type,
        case when query_id % 5 = 0 then 'kept' else cast(assertion_id as string) end as query_seed_assertion_id
    from v_queries join (select query_id, assertion_id from v_found where want = 0 and rank = 1) using (query_id)""")
def queries_with_seeds(c):
    path, again = files.scratch_folder(c.spark), files.scratch_folder(c.spark)
    rows = c.queries.select(F.col("query_id").cast("string").alias("query_id"), "query_text", "epistemic_type",
                            F.when(F.col("query_id") % 5 == 0, "kept").alias("query_seed_assertion_id"))
    files.write_json(rows, path)
    seeds = neutral_seeds(found(c)).withColumn("query_id", F.col("query_id").cast("string"))
    files.write_json(tables.with_seeds(files.read_queries(c.spark, path, one_per_line=True), seeds), again)
    return (files.read_queries(c.spark, again, one_per_line=True)
            .select("query_id", "epistemic_type", "query_seed_assertion_id"))
