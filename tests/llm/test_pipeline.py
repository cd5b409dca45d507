import hashlib
import os

import __spark_entry__ as entry_points
import corpus_pipeline
from odd_rows import rows_of
from test_decontaminate import brute as contaminated
from test_quality import brute as judged
from test_simhash import brute_fingerprint, brute_groups

from claimgraph.llm import language
from claimgraph.llm.common import table

SF_DIR = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = table(spark, SF_DIR, "documents")
    items = [tuple(r) for r in table(spark, SF_DIR, "benchmark").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted((r["doc_id"], r["text"], r["lang"]) for r in docs.collect())
        out = stage(spark, docs, SF_DIR)
        if name == "tokens":
            got = {r["doc_id"]: r["decoded_sha256"] for r in out.collect()}
            assert got == {d: hashlib.sha256(t.encode()).hexdigest() for d, t, _ in rows}
            break
        assert out.columns == docs.columns
        kept = sorted(r["doc_id"] for r in out.collect())
        if name == "language_id":
            found = language.identify(docs).where("lang_pred <> 'und' and score >= 0.5")
            assert kept == sorted(r["doc_id"] for r in found.collect()) and len(kept) > 0.95 * len(rows)
        elif name == "quality_rules":
            assert kept == sorted(r[0] for r in judged(rows) if r[-1])
        elif name == "near_dedup":
            roots = brute_groups([brute_fingerprint(t) for _, t, _ in rows])
            assert kept == sorted(rows[k][0] for k in set(roots)) and len(kept) < len(rows)
        elif name == "decontamination":
            assert kept == sorted(r[0] for r in contaminated([r[:2] for r in rows], items) if not r[5])
        docs = spark.createDataFrame(out.toPandas(), docs.schema)


def test_run_is_registered_and_whole(spark):
    out = entry_points.queries()["pipeline"](spark, SF_DIR)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 50
    assert "pipeline" not in entry_points.oracle_sql()


def test_every_stage_survives_odd_rows(spark, odd_docs, no_docs, tmp_path):
    spark.createDataFrame([(0, "one two"), (None, None)], "item_id bigint, text string").write.parquet(
        os.path.join(tmp_path, "benchmark.parquet"))
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert name == "tokens" or out.columns == docs.columns
            assert len(rows_of(out.select("doc_id"))) <= docs.count()
