from claimgraph.functions import summaries
from claimgraph.operators import report as D


def bundle(spark, keys, rows):
    fields = "n_pairs bigint, mean_baseline double, mean_treatment double, median_baseline double, median_treatment double, wilcoxon_p double, " \
             "cohens_d double, rank_biserial double, ci_low double, ci_high double, effect_size_label string, error string"
    return spark.createDataFrame(rows, ", ".join(f"{k} string" for k in keys) + ", " + fields)


def test_nested_results(spark, tmp_path):
    full, short = (9, 1.0, 2.0, 1.0, 2.0, 0.01, 0.9, 1.0, 0.5, 1.5, "large", None), (2, *[None] * 10, "insufficient data (n<3)")
    queries = spark.createDataFrame([(1, "normative"), (2, "mixed"), (3, "mixed")], "query_id int, epistemic_type string")
    made = D.nested_results(
        queries, spark.createDataFrame([(3, "no results")], "query_id int, error string"),
        spark.createDataFrame([("A", "ac", 0.5, 0.25, 2), ("A", "vtp", 0.1, 0.2, 2)], "condition string, metric string, mean double, median double, n bigint"),
        bundle(spark, ["pair", "metric"], [("A_vs_D", "ac", *full), ("B_vs_D", "ac", *short)]),
        bundle(spark, ["epistemic_type", "pair", "metric"], [("mixed", "A_vs_D", "ac", *full)]),
        bundle(spark, ["stratum", "pair", "metric"], []),
        spark.createDataFrame([("A", 2, 0.2), ("A", 1, 0.1)], "condition string, k int, vtp double"),
        spark.createDataFrame([("B", 5, 1.0)], "condition string, k int, csr double"))
    made.write.json(str(tmp_path / "out"))
    back = spark.read.schema(made.schema).json(str(tmp_path / "out"))
    row = back.first().asDict(recursive=True)
    assert (row["n_queries"], row["n_failed"], row["query_distribution"]) == (3, 1, {"normative": 1, "mixed": 2})
    assert row["results_by_condition"]["A"]["ac"] == {"mean": 0.5, "median": 0.25, "n": 2}
    assert row["statistical_tests"]["A_vs_D"]["ac"]["ci_95"] == [0.5, 1.5]
    assert row["statistical_tests"]["B_vs_D"]["ac"]["error"].startswith("insufficient") and row["statistical_tests"]["B_vs_D"]["ac"]["ci_95"] is None
    assert row["subgroup_by_epistemic_type"]["mixed"]["A_vs_D"]["ac"]["n_pairs"] == 9 and row["subgroup_by_repetitiveness"] == {}
    assert row["k_invariance_curves"]["vtp_normative"]["A"] == [{"k": 1, "value": 0.1}, {"k": 2, "value": 0.2}]
    flat = D.flat_results(back)
    assert flat.count() == 2 + 2 + 2 + 2 + 1 + 0 + 2 + 1 and flat.where("section = 'type'").first()["subgroup"] == "mixed"


def test_regulation_block(spark):
    rows = [(1, "REG", layer, at, f"{layer} {at}", doc, layer, 0.5) for layer, at, doc in
            [("ground", 2, "b"), ("backing", 1, "a"), ("ground", 1, "c")]]
    rows += [(2, "ACT", "warrant", 1, "must", "z", "warrant", 0.805)]
    context = spark.createDataFrame(rows, "query_id int, regulation string, layer string, position int, claim_text string, source_document string, "
                                          "discourse_role string, confidence double")
    got = {r.query_id: r.context_block for r in summaries.regulation_block(context).collect()}
    head = "Cross-document regulation-anchored context [regulation_anchor]:\nCross-document context anchored on "
    assert got[1] == (head + "[REG] (contributing docs: a, b, c):\n  Ground layer (peripheral documents):\n"
                      "    [GROUND] [regulation_anchor] ground 1 (source: c, conf: 0.50)\n    [GROUND] [regulation_anchor] ground 2 (source: b, conf: 0.50)\n"
                      "  Backing layer (institutional authority):\n    [BACKING] [regulation_anchor] backing 1 (source: a, conf: 0.50)")
    assert got[2].splitlines()[2:] == ["  Warrant layer (authoritative source):", "    [WARRANT] [regulation_anchor] must (source: z, conf: 0.81)"]
    assert summaries.regulation_block(context.limit(0)).count() == 0
