"""Typed rows from the JSON text that extractors return.

Elements are read as variants, so one malformed element costs only itself.  A
response that does not parse at all is kept by ``failed_responses`` for a retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph import schemas as S
from claimgraph.functions.text import let, strip


def unfenced(raw: Column) -> Column:
    """Response text without a code fence around it."""
    text = strip(raw)
    inner = F.when(F.startswith(text, F.lit("```")), F.get(F.split(text, "```", 3), F.lit(1))).otherwise(text)
    return strip(F.rtrim(strip(F.regexp_replace(inner, r"\Ajson", "")), F.lit("`")))


def parsed(responses: DataFrame) -> DataFrame:
    return responses.withColumn("doc", F.try_parse_json(unfenced(F.col("raw"))))


def failed_responses(responses: DataFrame) -> DataFrame:
    return parsed(responses).where("doc is null").drop("doc")


def usable_responses(responses: DataFrame) -> DataFrame:
    return parsed(responses).where("doc is not null").drop("doc")


def _value(element: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(element, f"$.{path}", kind)


def _elements(rows: DataFrame, array: Column) -> DataFrame:
    """One row per object in the array; other elements are skipped."""
    kept = [c for c in rows.columns if c not in ("raw", "doc")]
    return (rows.select(*kept, F.posexplode(array).alias("pos", "e"))
            .where(F.try_variant_get("e", "$", "map<string,variant>").isNotNull()))


def _array(doc: Column, path: str = "$") -> Column:
    return F.try_variant_get(doc, path, "array<variant>")


def _text(element: Column, path: str, default: str = "") -> Column:
    return F.coalesce(_value(element, path, "string"), F.lit(default))


def _texts(element: Column, path: str) -> Column:
    return F.coalesce(_value(element, path, "array<string>"), F.array().cast("array<string>"))


def _one_of(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def normal_coverage(value: Column) -> Column:
    value = F.when(value == "conditional", "conditional_override").otherwise(value)
    return _one_of(value, S.COVERAGES, "universal")


def normal_completeness(value: Column) -> Column:
    return _one_of(value, S.COMPLETENESS, "unknown")


def normal_scope_source(value: Column) -> Column:
    return _one_of(value, S.SCOPE_SOURCES, "unknown")


def normal_predicate(value: Column) -> Column:
    return _one_of(value, S.PREDICATES, "relates_to")


def scope_of(e: Column) -> Column:
    """The nested scope of an element; absent parts take their defaults."""
    def flag(path: str) -> Column:
        return F.coalesce(_value(e, path, "boolean"), F.lit(True))

    none = F.lit(None)
    temporal = F.struct(
        _value(e, "scope.temporal.season", "string").alias("season"),
        _texts(e, "scope.temporal.months").alias("months"),
        _texts(e, "scope.temporal.days_of_week").alias("days_of_week"),
        none.cast("date").alias("date_range_start"), none.cast("date").alias("date_range_end"),
        none.cast("string").alias("time_of_day_start"), none.cast("string").alias("time_of_day_end"),
        _value(e, "scope.temporal.fiscal_period", "string").alias("fiscal_period"),
        flag("scope.temporal.is_default").alias("is_default"))
    geographic = F.struct(*[_texts(e, f"scope.geographic.{n}").alias(n)
                            for n in ("countries", "states", "regions", "location_types")],
                          flag("scope.geographic.is_global").alias("is_global"))
    organizational = F.struct(*[_texts(e, f"scope.organizational.{n}").alias(n) for n in (
        "roles", "business_units", "products", "customer_segments", "account_types")],
        flag("scope.organizational.is_universal").alias("is_universal"))
    conditional = F.struct(
        _texts(e, "scope.conditional.conditions").alias("conditions"),
        F.coalesce(_value(e, "scope.conditional.thresholds", "map<string,string>"),
                   F.create_map().cast("map<string,string>")).alias("thresholds"),
        _texts(e, "scope.conditional.prerequisites").alias("prerequisites"),
        _texts(e, "scope.conditional.trigger_events").alias("trigger_events"))
    return F.struct(temporal.alias("temporal"), geographic.alias("geographic"),
                    organizational.alias("organizational"), conditional.alias("conditional"),
                    normal_coverage(_value(e, "scope_coverage", "string")).alias("coverage"),
                    normal_completeness(_value(e, "scope_completeness", "string")).alias("completeness"),
                    normal_scope_source(_value(e, "scope_source", "string")).alias("source"),
                    none.cast("string").alias("reviewer_note"))


def parse_assertions(responses: DataFrame) -> DataFrame:
    """``responses``: (chunk_id, document_id, doc_title, raw) to typed assertions.

    The id is derived from chunk and position, so a retried task repeats it.
    """
    e = F.col("e")
    rows = _elements(parsed(responses), _array(F.col("doc")))
    return rows.select(
        F.sha2(F.concat_ws(":", "chunk_id", "pos"), 256).alias("assertion_id"), "chunk_id", "document_id", "pos",
        _text(e, "claim_text").alias("claim_text"), _text(e, "subject").alias("subject"),
        normal_predicate(_value(e, "predicate_type", "string")).alias("predicate_type"),
        _text(e, "object_text").alias("object_text"),
        _value(e, "object_value", "double").alias("object_value"),
        _value(e, "object_unit", "string").alias("object_unit"),
        # Thirty fields would outgrow one generated method; inside an array lambda they are evaluated one by one.
        let(e, scope_of).alias("scope"), _text(e, "claim_text").alias("source_text"),
        F.col("doc_title").alias("source_document"), F.lit("").alias("source_url"),
        _text(e, "authority_level", "reference").alias("authority_level"),
        F.lit("authoritative").alias("epistemic_status"),
        F.coalesce(_value(e, "confidence", "double"), F.lit(0.8)).alias("confidence"),
        F.lit("llm").alias("extraction_method"), F.lit("pending").alias("review_status"),
        _texts(e, "topics").alias("topics"), _texts(e, "entities").alias("entities"),
        _texts(e, "regulations").alias("regulations"), _texts(e, "keywords").alias("keywords"),
        _text(e, "domain", "finance").alias("domain"))


def parse_relations(responses: DataFrame) -> DataFrame:
    """``responses``: (document_id, raw) to relations; unknown types are dropped."""
    e, kind = F.col("e"), _value(F.col("e"), "relation_type", "string")

    def flag(name: str, types: list[str]) -> Column:
        return F.coalesce(_value(e, name, "boolean"), kind.isin(types)).alias(name)

    rows = _elements(parsed(responses), _array(F.col("doc"))).where(kind.isin(S.RELATION_TYPES))
    return rows.select(
        F.sha2(F.concat_ws(":", "document_id", "pos"), 256).alias("relationship_id"), "document_id", "pos",
        _text(e, "source_assertion_id").alias("source_assertion_id"),
        _text(e, "target_assertion_id").alias("target_assertion_id"), kind.alias("relation_type"),
        flag("is_truth_preserving", S.TRUTH_PRESERVING), flag("is_defeasible", S.DEFEASIBLE),
        flag("is_bidirectional", S.BIDIRECTIONAL),
        *[_text(e, n).alias(n) for n in ("evidence_text", "logical_form", "mechanism", "strength")],
        _text(e, "directionality", "A_to_B").alias("directionality"),
        F.coalesce(_value(e, "confidence", "double"), F.lit(0.8)).alias("confidence"),
        F.lit("llm_within_doc").alias("extraction_method"), F.lit(0).alias("derivation_depth"),
        F.lit("pending").alias("review_status"))


def parse_grammar(responses: DataFrame) -> DataFrame:
    """``responses``: (document_id, raw); the last classification of an id wins."""
    e = F.col("e")
    rows = (_elements(parsed(responses), _array(F.col("doc"), "$.classifications"))
            .withColumn("assertion_id", _value(e, "assertion_id", "string")).where("assertion_id is not null"))
    last = F.max_by(F.struct(_value(e, "discourse_role", "string").alias("r"),
                             _value(e, "validity_claim_type", "string").alias("v")), "pos")
    return (rows.groupBy("document_id", "assertion_id").agg(last.alias("last"))
            .select("document_id", "assertion_id", F.col("last.r").alias("discourse_role"),
                    F.col("last.v").alias("validity_claim_type")))


def parse_adjudications(responses: DataFrame) -> DataFrame:
    """``responses``: (assertion_id_a, assertion_id_b, raw) to one verdict per pair."""
    d = F.col("doc")
    answer = F.when(_array(d).isNotNull(), F.get(_array(d), F.lit(0))).otherwise(d)
    e = F.col("e")
    return (parsed(responses).where("doc is not null").withColumn("e", answer)
            .where(F.try_variant_get("e", "$", "map<string,variant>").isNotNull())
            .select("assertion_id_a", "assertion_id_b",
                    _text(e, "relationship_type", "FALSE_POSITIVE").alias("relationship_type"),
                    _text(e, "explanation").alias("explanation"),
                    _text(e, "conflicting_text").alias("conflicting_text"),
                    _value(e, "governing_assertion_id", "string").alias("governing_assertion_id"),
                    _text(e, "reviewer_question").alias("reviewer_question"),
                    F.coalesce(_value(e, "confidence", "double"), F.lit(0.8)).alias("confidence"),
                    *[_text(e, f"scope_overlap.{n}", "unknown").alias(f"overlap_{n}")
                      for n in ("temporal", "geographic", "organizational")]))
