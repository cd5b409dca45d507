import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from claimgraph import schemas as S
from claimgraph.functions import annotate
from claimgraph.functions.ranking import running, sort_bucket
from claimgraph.operators import assertions as A


def test_seven_types_preserve_truth(spark):
    df = spark.createDataFrame([(t,) for t in S.RELATION_TYPES], "relation_type string").select("relation_type", *A.relation_flags())
    rows = {r.relation_type: r for r in df.collect()}
    assert len(rows) == 16 and sum(r.is_truth_preserving for r in rows.values()) == 7
    rebuts = rows["REBUTS"]
    assert (rebuts.is_defeasible, rebuts.is_truth_preserving, rebuts.is_bidirectional) == (True, False, False)


def test_dedup_prefers_specific_predicate_and_is_idempotent(spark):
    rows = [(1, "c", "Banks must report", "relates_to"), (2, "c", "  banks must REPORT ", "requires"),
            (3, "c", "banks must report", "defines"), (4, "d", "Banks must report", "relates_to")]
    df = spark.createDataFrame(rows, "assertion_id int, chunk_id string, claim_text string, predicate_type string")
    once = A.dedup_assertions(df)
    assert sorted(r.assertion_id for r in once.collect()) == [2, 4]
    assert A.dedup_assertions(once).count() == 2


def test_zero_confidence_reads_as_default(spark):
    df = spark.createDataFrame([(None,), (0.0,), (0.3,)], "c double").select(A.positive_or(F.col("c")).alias("c"))
    assert [r.c for r in df.collect()] == [0.8, 0.8, 0.3]


def test_batches_of_a_hot_group_match_a_plain_window(spark):
    # One document holds most rows and spans several buckets.
    df = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.col("id") % 7).otherwise(99).alias("doc"), F.col("id").alias("pos"))
    got = A.batches(df, "doc", F.col("pos"), 50, bucket=sort_bucket(F.col("pos"), 100))
    n = F.row_number().over(Window.partitionBy("doc").orderBy("pos")) - 1
    want = df.select("doc", "pos", F.floor(n / 50).alias("batch"), (n % 50).alias("in_batch"))
    assert sorted(map(tuple, got.select("doc", "pos", "batch", "in_batch").collect())) == sorted(map(tuple, want.collect()))


def test_running_sums_over_struct_buckets(spark):
    df = spark.createDataFrame([(1, c / 4, i) for i, c in enumerate([3, 1, 2, 3, 1, 0, 2, 3])], "q int, c double, i int")
    bucket = F.struct((-F.col("c")).alias("a"), F.floor(F.col("i") / 2).alias("b"))
    got = running(df, ["q"], [F.desc("c"), F.col("i")], bucket, {"rank": F.lit(1)}).orderBy("rank").collect()
    assert [(r.c, r.i) for r in got] == sorted([(r.c, r.i) for r in got], key=lambda x: (-x[0], x[1]))
    assert [r.rank for r in got] == list(range(1, 9))


def test_cross_batches(spark):
    df = spark.range(120).select(F.lit(1).alias("doc"), F.col("id").alias("pos"))
    got = A.cross_batches(df, "doc", F.col("pos")).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.cross_batch, set()).add(r.pos)
    assert windows == {0: set(range(40, 60)), 1: set(range(90, 110))}


def test_hub_concepts_make_no_cluster(spark):
    rows = [(i, i % 5, "authoritative", ["hub"] + (["small"] if i < 3 else []) + ([""] if i == 1 else [])) for i in range(60)]
    df = spark.createDataFrame(rows, "assertion_id int, document_id int, epistemic_status string, entities array<string>")
    assert [(r.concept, r.size, r.assertion_ids) for r in A.concept_clusters(df).collect()] == [("small", 3, [0, 1, 2])]


def test_cross_document_pairs_skip_linked_and_keep_null_documents(spark):
    rows = [(1, 1, "ok", ["x"]), (2, 1, "ok", ["x"]), (3, 2, "ok", ["x"]), (4, None, "ok", ["x"]), (5, 3, "deprecated", ["x"])]
    df = spark.createDataFrame(rows, "assertion_id int, document_id int, epistemic_status string, entities array<string>")
    linked = spark.createDataFrame([(3, 1)], "source_assertion_id int, target_assertion_id int")
    got = {(r.low_id, r.high_id) for r in A.cross_document_pairs(df, linked).collect()}
    assert got == {(2, 3), (1, 4), (2, 4), (3, 4)}


def test_a_concept_of_any_size_gives_all_its_pairs(spark):
    n = 5000
    df = spark.range(n).selectExpr("id as assertion_id", "id % 3 as document_id", "'ok' as epistemic_status", "array('hub') as entities")
    none = spark.createDataFrame([], "source_assertion_id bigint, target_assertion_id bigint")
    pairs = A.cross_document_pairs(df, none)
    sizes = [len(range(d, n, 3)) for d in range(3)]
    want = sum(a * b for i, a in enumerate(sizes) for b in sizes[:i])
    row = pairs.agg(F.count("*").alias("n"), F.count_if(F.col("low_id") >= F.col("high_id")).alias("bad"),
                    F.count_if(F.col("low_id") % 3 == F.col("high_id") % 3).alias("same")).first()
    assert (row.n, row.bad, row.same) == (want, 0, 0)
    assert A.cross_document_pairs(df, none, 50).count() == 0


def test_blocks_do_not_change_the_pairs(spark):
    rows = [(i, i % 4, "ok", ["hub"] + (["small"] if i < 5 else [])) for i in range(70)]
    df = spark.createDataFrame(rows, "assertion_id int, document_id int, epistemic_status string, entities array<string>")
    links = A.clustered_links(df)
    found = [sorted(tuple(r) for r in A.cluster_pairs(links, block).collect()) for block in (1, 7, 1000)]
    assert found[0] == found[1] == found[2] and len(set(found[0])) == len(found[0])
    assert len(found[0]) == sum(a % 4 != b % 4 for n in (70, 5) for a in range(n) for b in range(a))


def test_accepted_relations_are_first_per_unordered_pair(spark):
    docs = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "assertion_id int, document_id int")
    found = spark.createDataFrame([(10, 1, 2), (11, 2, 1), (12, 1, 3), (13, 2, 3)],
                                  "relationship_id int, source_assertion_id int, target_assertion_id int")
    none = found.limit(0)
    got = A.accept_relations(found, docs, none, [F.col("relationship_id")]).collect()
    assert sorted(r.relationship_id for r in got) == [10, 13]


def test_relation_coverage(spark):
    claims = spark.createDataFrame([(d,) for d, n in [(1, 30), (2, 29), (3, 31)] for _ in range(n)], "document_id int")
    rels = spark.createDataFrame([(3,)], "document_id int")
    got = {r.document_id: (r.is_complete, r.retry) for r in A.relation_coverage(claims, rels).collect()}
    assert got == {1: (False, True), 2: (True, False), 3: (True, False)}


def test_annotators(spark):
    cases = [("Banks must maintain a ratio above 6%", "warrant", "normative"),
             ("Per section 4.2, requirements are set", "backing", "constative"),
             ("Unless the entity must be exempt", "rebuttal", "normative"),
             ("Generally, rates rise", "qualifier", "constative"),
             ("This policy is intended to protect customers", "ground", "expressive"),
             ("The ratio is 5.8%", "ground", "constative")]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string").select(
        annotate.discourse_role(F.col("t")).alias("r"), annotate.validity_type(F.col("t")).alias("v"))
    assert [(r.r, r.v) for r in df.collect()] == [(r, v) for _, r, v in cases]


def test_regulation_mentions_are_whole_words(spark):
    df = spark.createDataFrame([("under BASEL III and the dodd-frank act; SECtion, mifid ii.",)], "t string")
    got = df.select(annotate.regulation_mentions(F.col("t")).alias("m")).first().m
    assert got == ["Basel III", "Dodd-Frank", "MiFID", "MiFID II"]


def test_mentions_of_overlapping_names(spark, monkeypatch):
    names = ["MiFID", "MiFID II", "mifid iix", "II", "C++", "a.b", "a", "§ 5", "--", "Éa b", "Éa", "b c", "B", "under_score"]
    texts = ["MIFID IIX and mifid ii", "mifid iixy", "c++ c+++ xc++", "a.b axb a.bc", "see § 5, § 51", "éa b c", "under_score_ under_score", "", None]

    def brute(text):
        low = text.lower()
        return {n for n in names if re.search(r"\w", n) and re.search(r"(?<!\w)" + re.escape(n.lower()) + r"(?!\w)", low)}

    want = sorted((k, n) for k, t in enumerate(texts) if t is not None for n in brute(t))
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] * 2, "id int, t string")
    table = spark.createDataFrame([(n,) for n in [*names, names[0], None]], "name string")
    listed = rows.select("id", annotate.name_mentions(F.col("t"), names).alias("m")).collect()
    assert sorted({(r.id, n) for r in listed for n in r.m or []}) == want
    assert all(r.m == [n for n in names if n in r.m] for r in listed if r.m is not None)
    for most in (annotate.PATTERN_NAMES, 3):
        monkeypatch.setattr(annotate, "PATTERN_NAMES", most)
        assert sorted(map(tuple, annotate.table_mentions(rows, table, "id", "t").collect())) == want
        assert annotate.table_mentions(rows, table.limit(0), "id", "t").count() == 0
