"""What the physical plans must and must not hold."""

import re

from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from claimgraph import session
from claimgraph.operators import paths as P
from claimgraph.operators import retrieval as R

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry_points.queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(spark):
    for name in ("r06_top_assertions", "c03_latest_per_firm", "p02_backward_chains", "m34_top_document_assertions"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, SF_DIR)), name


def test_newest_firms_take_an_ordered_top(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["c04_newest_firms"](spark, SF_DIR))


def test_filters_and_columns_reach_the_scan(spark):
    from claimgraph.operators import curation as U
    from claimgraph.sources.derived import Corpus
    text = plan(QUERIES["c11_stratified_queries"](spark, SF_DIR))
    assert "ReadSchema" in text
    rows = Corpus(spark, SF_DIR).table("labels").where("quality = 1").select("doc_id")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(quality,1\)", plan(rows))
    assert "n_chars" not in re.findall(r"ReadSchema: (\S+)", plan(Corpus(spark, SF_DIR).assertions.select("assertion_id")))[0]
    assert U.FIRST_YEAR < U.LAST_YEAR


def test_text_is_scanned_few_times(spark):
    for name, most in (("m29_document_readiness", 5), ("m30_document_pair_edges", 6), ("m34_top_document_assertions", 5),
                       ("a11_cross_document_pairs", 6), ("x03_structural_filter", 8), ("g07_merged_edges", 12)):
        text = plan(QUERIES[name](spark, SF_DIR)).split("== Initial Plan ==")[-1]
        assert len(re.findall(r"FileScan parquet \[[^\]]*text", text)) <= most, name


def test_no_cross_products_or_row_by_row_python(spark):
    for name in ("m29_document_readiness", "m30_document_pair_edges", "a11_cross_document_pairs", "g07_merged_edges", "p05_directed_neighborhood",
                 "t06_chunk_articles"):
        text = plan(QUERIES[name](spark, SF_DIR))
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text, name


def test_gazetteer_names_need_no_shuffle_of_texts(spark):
    from claimgraph.functions import annotate
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    # A regulation's name holds the word Exchange, so the operator is looked for with its partitioning.
    shuffled = re.compile(r"Exchange (hash|range|Round|Single).*")
    assert not shuffled.search(plan(docs.select("doc_id", F.explode(annotate.regulation_mentions(F.col("text"))))))
    table = spark.createDataFrame([("Basel III",), ("Basel",), ("der",)], "name string")
    found = plan(annotate.table_mentions(docs, table, "doc_id", "text"))
    assert "Join" not in found and all("text" not in m.group() for m in shuffled.finditer(found))


def test_few_found_rows_do_not_shuffle_the_assertions(spark, monkeypatch):
    """Whatever the broadcast limit: a batch's rows go to the assertions; more rows than that are joined by a shuffle, with the same result."""
    claims = spark.createDataFrame([(i, 0.9, "normative", "warrant", "d", "authoritative", f"text {i}") for i in range(50)],
                                   "assertion_id bigint, confidence double, validity_claim_type string, discourse_role string, "
                                   "source_document string, epistemic_status string, claim_text string")
    found = spark.createDataFrame([(1, 3), (1, 3), (2, 7), (2, 99)], "query_id bigint, assertion_id bigint")
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {}
        for name, most in (("few", 10), ("many", 1)):
            monkeypatch.setattr(session, "FEW_ROWS", most)
            rows = R.fetch(found, claims)
            got[name] = sorted((r.query_id, r.assertion_id, r.claim_text) for r in rows.collect())
            plan = rows._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning" in plan) == (name == "many"), plan
        assert got["few"] == got["many"] == [(1, 3, "text 3"), (1, 3, "text 3"), (2, 7, "text 7")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_neighbourhood_tasks_grow_with_the_centres(spark, monkeypatch):
    """What one task sorts is bounded: more centres are dealt to more tasks, and nothing is sorted before."""
    centres = spark.createDataFrame([(i, f"A:{i}") for i in range(40)], "query_id bigint, node string")
    edges = spark.createDataFrame([(f"A:{i}", f"A:{i + 1}", f"L{i:03d}", "CAUSES") for i in range(41)], "src string, dst string, edge_id string, type string")
    whole = sorted((r.query_id, r.edge_ids) for r in P.neighborhood_paths(centres, edges, 2, 5).collect())
    monkeypatch.setattr(P, "PATHS_PER_TASK", 10)
    found = P.neighborhood_paths(centres, edges, 2, 5)
    assert "hashpartitioning(query_id" in plan(found) and re.search(r"start#\d+, 20\)", plan(found))
    assert sorted((r.query_id, r.edge_ids) for r in found.collect()) == whole
