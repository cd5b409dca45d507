"""Explicit schemas and enumerations of the claim-graph data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Enumerations of the data model.
PREDICATES = ["defines", "requires", "prohibits", "permits", "constrains", "classifies",
              "implements", "supersedes", "relates_to", "causes", "governs"]
EPISTEMIC_STATUSES = ["authoritative", "inferred", "contested", "deprecated", "orphaned", "derived"]
DEAD_STATUSES = ["deprecated", "orphaned"]
REVIEW_STATUSES = ["pending", "validated", "rejected", "deferred"]
COVERAGES = ["universal", "default", "conditional_override", "exception"]
COMPLETENESS = ["explicit", "partial", "implicit", "unknown"]
SCOPE_SOURCES = ["stated", "inferred", "unknown"]
DISCOURSE_ROLES = ["warrant", "ground", "claim", "backing", "rebuttal", "qualifier", "unclassified"]
VALIDITY_TYPES = ["constative", "normative", "expressive", "unclassified"]
RELATION_TYPES = ["ENTAILS", "CONTRADICTS", "EQUIVALENT", "CAUSES", "INHIBITS", "CORRELATES_WITH",
                  "SPECIALIZES", "GENERALIZES", "INSTANTIATES", "CLASSIFIES", "DEFINES",
                  "OPERATIONALIZES", "PRECEDES", "TRIGGERS", "SUPERSEDES", "REBUTS"]
CONFLICT_TYPES = ["CONTRADICTS", "SUPERSEDES", "SPECIALIZES", "DUPLICATE", "COMPLEMENTARY",
                  "FALSE_POSITIVE"]

# Which relation types carry which flag.
TRUTH_PRESERVING = ["ENTAILS", "EQUIVALENT", "DEFINES", "TRIGGERS", "SPECIALIZES", "GENERALIZES",
                    "SUPERSEDES"]
DEFEASIBLE = ["CAUSES", "INHIBITS", "CORRELATES_WITH", "REBUTS"]
BIDIRECTIONAL = ["CONTRADICTS", "EQUIVALENT", "CORRELATES_WITH"]

_strings = T.ArrayType(T.StringType())


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype) for name, dtype in fields.items()])


RAW_ARTICLE = struct(title=T.StringType(), url=T.StringType(), content=T.StringType(),
                     word_count=T.IntegerType(), fetched_at=T.TimestampType(), domain=T.StringType())

CHUNK = struct(chunk_id=T.StringType(), document_id=T.StringType(), sequence=T.IntegerType(),
               section_title=T.StringType(), content=T.StringType(), token_estimate=T.IntegerType(),
               title=T.StringType(), url=T.StringType(), domain=T.StringType())

TEMPORAL_SCOPE = struct(season=T.StringType(), months=_strings, days_of_week=_strings,
                        date_range_start=T.DateType(), date_range_end=T.DateType(),
                        time_of_day_start=T.StringType(), time_of_day_end=T.StringType(),
                        fiscal_period=T.StringType(), is_default=T.BooleanType())
GEOGRAPHIC_SCOPE = struct(countries=_strings, states=_strings, regions=_strings,
                          location_types=_strings, is_global=T.BooleanType())
ORGANIZATIONAL_SCOPE = struct(roles=_strings, business_units=_strings, products=_strings,
                              customer_segments=_strings, account_types=_strings,
                              is_universal=T.BooleanType())
CONDITIONAL_SCOPE = struct(conditions=_strings, thresholds=T.MapType(T.StringType(), T.StringType()),
                           prerequisites=_strings, trigger_events=_strings)
SCOPE = struct(temporal=TEMPORAL_SCOPE, geographic=GEOGRAPHIC_SCOPE,
               organizational=ORGANIZATIONAL_SCOPE, conditional=CONDITIONAL_SCOPE,
               coverage=T.StringType(), completeness=T.StringType(), source=T.StringType(),
               reviewer_note=T.StringType())

ASSERTION = struct(assertion_id=T.StringType(), chunk_id=T.StringType(), document_id=T.StringType(),
                   claim_text=T.StringType(), subject=T.StringType(), predicate_type=T.StringType(),
                   object_text=T.StringType(), object_value=T.DoubleType(), object_unit=T.StringType(),
                   source_text=T.StringType(), source_document=T.StringType(),
                   source_url=T.StringType(), authority_level=T.StringType(),
                   epistemic_status=T.StringType(), confidence=T.DoubleType(),
                   extraction_method=T.StringType(), review_status=T.StringType(), topics=_strings,
                   entities=_strings, regulations=_strings, keywords=_strings, domain=T.StringType(),
                   discourse_role=T.StringType(), validity_claim_type=T.StringType(), scope=SCOPE)

GRAMMAR_ENTRY = struct(assertion_id=T.StringType(), discourse_role=T.StringType(),
                       validity_claim_type=T.StringType())

RELATION = struct(relationship_id=T.StringType(), source_assertion_id=T.StringType(),
                  target_assertion_id=T.StringType(), relation_type=T.StringType(),
                  is_bidirectional=T.BooleanType(), is_truth_preserving=T.BooleanType(),
                  is_defeasible=T.BooleanType(), evidence_text=T.StringType(),
                  logical_form=T.StringType(), mechanism=T.StringType(), strength=T.StringType(),
                  directionality=T.StringType(), confidence=T.DoubleType(),
                  extraction_method=T.StringType(), derivation_depth=T.IntegerType(),
                  review_status=T.StringType())

FILING_INDEX = struct(cik=T.StringType(), company=T.StringType(), sic=T.StringType(),
                      filing_date=T.StringType(), accession_no=T.StringType(), period=T.StringType())

EVAL_QUERY = struct(query_id=T.StringType(), query_text=T.StringType(),
                    epistemic_type=T.StringType(), source_doc=T.StringType(),
                    source_category=T.StringType(), generation_method=T.StringType(),
                    query_seed_assertion_id=T.StringType())

COST_LOG = struct(ts=T.TimestampType(), model=T.StringType(), input_tokens=T.IntegerType(),
                  output_tokens=T.IntegerType(), stage=T.StringType(), record_id=T.StringType())
