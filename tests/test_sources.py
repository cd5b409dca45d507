import json

import pytest
from pyspark.sql import functions as F

from claimgraph.functions import scope as sc
from claimgraph.operators import assertions as A
from claimgraph.operators.chunking import common_chunks
from claimgraph.sources import files, responses, tables
from claimgraph.sources.derived import Corpus


def test_malformed_elements_cost_only_themselves(spark):
    items = [{"claim_text": "ok", "predicate_type": "requires", "confidence": 0.9, "topics": ["a"],
              "scope": {"temporal": {"season": "winter", "is_default": False}}, "scope_coverage": "conditional"},
             "stray", 7, None, {"predicate_type": "odd", "scope_coverage": "odd", "scope_completeness": "odd"}]
    raws = [("c1", json.dumps(items)), ("c2", "```json\n" + json.dumps(items[:1]) + "\n```"), ("c3", "not json"), ("c4", "{}")]
    df = spark.createDataFrame([(c, "d", "T", r) for c, r in raws], "chunk_id string, document_id string, doc_title string, raw string")
    rows = responses.parse_assertions(df).orderBy("chunk_id", "pos").collect()
    assert [(r.chunk_id, r.pos) for r in rows] == [("c1", 0), ("c1", 4), ("c2", 0)]
    first, last = rows[0], rows[1]
    assert (first.scope.temporal.season, first.scope.temporal.is_default, first.scope.coverage) == ("winter", False, "conditional_override")
    assert (last.claim_text, last.predicate_type, last.confidence, last.scope.coverage, last.scope.completeness) == (
        "", "relates_to", 0.8, "universal", "unknown")
    assert last.scope.geographic.is_global and last.topics == []
    assert [r.chunk_id for r in responses.failed_responses(df).collect()] == ["c3"]


def test_relations_drop_unknown_types(spark):
    items = [{"relation_type": "ENTAILS", "source_assertion_id": "1", "target_assertion_id": "2"},
             {"relation_type": "RESEMBLES"}, {"relation_type": "REBUTS", "is_defeasible": False}]
    df = spark.createDataFrame([("d", "```" + json.dumps(items) + "```")], "document_id string, raw string")
    rows = responses.parse_relations(df).orderBy("pos").collect()
    assert [(r.relation_type, r.is_truth_preserving, r.is_defeasible, r.is_bidirectional) for r in rows] == [
        ("ENTAILS", True, False, False), ("REBUTS", False, False, False)]


def test_grammar_last_wins_and_missing_id_is_dropped(spark):
    text = json.dumps({"classifications": [{"assertion_id": "a", "discourse_role": "ground"}, {"discourse_role": "claim"},
                                           {"assertion_id": "a", "discourse_role": "warrant"}]})
    rows = responses.parse_grammar(spark.createDataFrame([("d", text)], "document_id string, raw string")).collect()
    assert [(r.assertion_id, r.discourse_role) for r in rows] == [("a", "warrant")]


def test_adjudication_list_and_default(spark):
    raws = [(1, 2, '[{"relationship_type": "DUPLICATE"}, {"relationship_type": "CONTRADICTS"}]'), (3, 4, '{"confidence": 0.5}'), (5, 6, "oops")]
    rows = responses.parse_adjudications(spark.createDataFrame(raws, "assertion_id_a int, assertion_id_b int, raw string")).collect()
    assert {(r.assertion_id_a, r.relationship_type, r.confidence) for r in rows} == {(1, "DUPLICATE", 0.8), (3, "FALSE_POSITIVE", 0.5)}


def test_scope_round_trip_and_defaults(spark):
    partial = '{"temporal": {"season": "winter", "is_default": false}, "conditional": {"thresholds": {"ratio": "6%"}}}'
    df = spark.createDataFrame([(partial,), ("{}",), (None,)], "t string").select(sc.from_text(F.col("t")).alias("s"))
    rows = df.select(sc.from_text(sc.to_text(F.col("s"))).alias("again"), "s").collect()
    assert all(r.again == r.s for r in rows)
    assert rows[0].s.temporal.season == "winter" and rows[0].s.conditional.thresholds == {"ratio": "6%"}
    assert rows[1].s == rows[2].s and rows[1].s.geographic.is_global and rows[1].s.coverage == "universal"


def test_reader_keeps_bad_records_aside(spark, tmp_path):
    (tmp_path / "good.json").write_text(json.dumps({"title": "Basel I", "content": "x", "word_count": 1}))
    (tmp_path / "bad.json").write_text("{broken")
    rows = files.read_articles(spark, str(tmp_path)).collect()
    assert sorted((r.title, r[files.BAD_RECORD] is not None) for r in rows if r.title) == [("Basel I", False)]
    assert sum(r[files.BAD_RECORD] is not None for r in rows) == 1


def test_array_files_give_one_row_per_element(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"chunk_id": "1", "sequence": 0}, {"chunk_id": "2", "sequence": 1}]))
    assert files.read_chunks(spark, str(tmp_path)).count() == 2


def test_grammar_map_file(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"a": {"assertion_id": "a", "discourse_role": "expressive"},
                                                 "b": {"discourse_role": "ground", "validity_claim_type": "normative"}}, indent=2))
    got = {r.assertion_id: r.discourse_role for r in files.read_grammar(spark, str(tmp_path)).collect()}
    assert got == {"a": "expressive", "b": "ground"}
    claims = spark.createDataFrame([("a", "claim", None), ("b", None, "constative"), ("c", None, "")],
                                   "assertion_id string, discourse_role string, validity_claim_type string")
    merged = {r.assertion_id: (r.discourse_role, r.validity_claim_type)
              for r in A.merge_grammar(claims, files.read_grammar(spark, str(tmp_path))).collect()}
    assert merged == {"a": ("unclassified", "unclassified"), "b": ("ground", "normative"), "c": ("unclassified", "unclassified")}


def test_manifest_parts(spark):
    text = "\n\n".join("Paragraph with enough characters in it to be kept. " * 5 for _ in range(25))
    filing = spark.createDataFrame([("1", "F", "6022", "2023-01", text, "")],
                                   "cik string, company string, sic string, period string, item1 string, item1a string")
    parts = files.manifest(common_chunks(filing), "filings", part_chunks=10).orderBy("part").collect()
    assert [(p.part, len(p.chunks), p.chunk_count) for p in parts] == [(0, 10, 25), (1, 10, 25), (2, 5, 25)]


def test_insert_and_update(spark):
    old = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "d"), (2, "c")], "k int, v string")
    assert [tuple(r) for r in tables.new_rows(new, old, ["k"], [F.col("v")]).collect()] == [(2, "c")]
    got = {r.k: r.v for r in tables.update_column(old.unionByName(new.limit(0)), spark.createDataFrame([(1, "z")], "k int, v string"), "k", "v").collect()}
    assert got == {1: "z"}


def test_repeated_insert_changes_nothing(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert tables.new_rows(rows, rows, ["k"], [F.col("v")]).count() == 0


def test_every_vector_of_the_table_is_drawn(spark, tmp_path):
    from claimgraph.sources.derived import Corpus
    n = 2000
    spark.range(n).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.range(n).selectExpr("id as doc_id", "'one line' as text", "'en' as lang", "'s' as source", "8L as n_chars").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.range(n).selectExpr("id as item_id", "'q' as text").write.parquet(f"{tmp_path}/benchmark.parquet")
    corpus = Corpus(spark, str(tmp_path))
    assert corpus.queries.select("vector").distinct().count() == n
    parts = corpus.view("v_vector_parts")
    assert parts.select("base_id").distinct().count() == n and parts.select("noise_id").distinct().count() > n / 4
    assert corpus.vectors.count() == n


def test_a_cluster_must_name_its_shared_folder():
    from claimgraph import session as X

    class Elsewhere:
        master, applicationId = "spark://somewhere:7077", "a"

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Unset:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Elsewhere(), Unset()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        X.shared_folder(Session())


def test_text_ids_get_ascending_numbers(spark):
    from claimgraph.sources import ids
    names = [f"{(k * 7919) % 997:04x}" for k in range(997)]
    rows = spark.createDataFrame([(n, names[k // 2]) for k, n in enumerate(names)], "a string, b string").repartition(5)
    table = ids.number_ids(rows.select("a"), rows.select("b"))
    pairs = sorted((r.id, r.number) for r in table.collect())
    assert [i for i, _ in pairs] == sorted(names) and [n for _, n in pairs] == sorted({n for _, n in pairs})
    coded = ids.encode(rows, table, "a", "b")
    assert dict(coded.dtypes) == {"a": "bigint", "b": "bigint"}
    assert sorted(map(tuple, ids.decode(coded, table, "a", "b").collect())) == sorted(map(tuple, rows.collect()))
    assert ids.encode(spark.createDataFrame([("zz",)], "a string"), table, "a").first().a is None


def test_a_vector_is_normed_once(spark, tmp_path):
    # The length of a mixture was computed again for each of its entries.
    spark.createDataFrame([(3, "a\nb", "s", "en", 3)], "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    vector = [0.6, 0.8] + [0.0] * 62
    spark.createDataFrame([(0, vector)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = Corpus(spark, str(tmp_path)).vectors
    plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "sqrt(aggregate(" in plan and "/ sqrt(" not in plan
    assert [round(x, 6) for x in rows.first().vector] == vector
