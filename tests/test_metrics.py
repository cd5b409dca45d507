import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from claimgraph.operators import analytics as N
from claimgraph.operators import metrics as M
from claimgraph.operators import stats as T

RESULT = "query_id bigint, condition string, rank bigint, vtp_rank bigint, assertion_id bigint, validity_claim_type string"


def queries(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id bigint, epistemic_type string")


def results(spark, rows):
    return spark.createDataFrame([(q, c, r, r, a, v) for q, c, r, a, v in rows], RESULT)


def values(df):
    return {(r.query_id, r.condition, r.metric): r.value for r in df.collect()}


def test_precision(spark):
    rows = [(1, "A", i + 1, i, "normative" if i < 3 else "constative") for i in range(12)] + [(2, "A", 1, 5, "normative"), (3, "A", 1, 6, "normative"), (3, "A", 2, 7, "constative")]
    cells = M.grid(queries(spark, (1, "normative"), (2, "mixed"), (3, "mixed"), (4, "constative")), ["A"])
    got = values(M.validity_precision(results(spark, rows), cells))
    assert got == {(1, "A", "vtp"): 0.3, (2, "A", "vtp"): 0.0, (3, "A", "vtp"): 1.0, (4, "A", "vtp"): 0.0}


def test_coverage(spark):
    rows = [(1, "A", r, a, "x") for r, a in enumerate([9, 1, 8, 2, 3, 4], start=1)]
    nb = spark.createDataFrame([(1, a) for a in (1, 2, 3, 4, 5)], "query_id bigint, assertion_id bigint")
    cells = M.grid(queries(spark, (1, "normative"), (2, "normative")), ["A", "B"])
    got = values(M.coverage(results(spark, rows), nb, cells))
    assert got[1, "A", "ac"] == 0.8 and got[1, "A", "cwe"] == 6.0
    assert got[1, "B", "ac"] == 0.0 and got[1, "B", "cwe"] == 50.0
    assert got[2, "A", "ac"] is None and got[2, "A", "cwe"] == 50.0


@settings(max_examples=10, deadline=None)
@given(found=st.lists(st.integers(0, 12), unique=True, max_size=10), near=st.sets(st.integers(0, 12), min_size=1))
def test_completeness_is_a_share_and_grows_with_k(spark, found, near):
    nb = spark.createDataFrame([(1, a) for a in near], "query_id bigint, assertion_id bigint")
    rows = [(1, c, r, a, "x") for c, k in (("A", 5), ("B", 10)) for r, a in enumerate(found[:k], start=1)]
    got = values(M.coverage(results(spark, rows), nb, M.grid(queries(spark, (1, "mixed")), ["A", "B"])))
    assert 0.0 <= got[1, "A", "ac"] <= got[1, "B", "ac"] <= 1.0
    least = next((k for k in range(1, len(found) + 1) if len(set(found[:k]) & near) / len(near) >= 0.8), 50)
    assert got[1, "B", "cwe"] == least


@pytest.mark.parametrize("numbers,want", [([0, 0, 3], 0.6667), ([1, 1, 1], 0.0), ([0, 0], 0.0), ([1, 2, 2, 5], 0.3)])
def test_gini(spark, numbers, want):
    df = spark.createDataFrame([("k", v) for v in numbers], "k string, v bigint")
    assert N.gini(df, ["k"], "v").first().gini == want


@settings(max_examples=10, deadline=None)
@given(numbers=st.lists(st.integers(0, 20), min_size=1, max_size=12))
def test_gini_matches_its_definition(spark, numbers):
    df = spark.createDataFrame([("k", v) for v in numbers], "k string, v bigint")
    got, n = N.gini(df, ["k"], "v", 9).first().gini, len(numbers)
    assert 0.0 <= got < 1.0
    want = 2 * sum((i + 1) * v for i, v in enumerate(sorted(numbers))) / (n * sum(numbers)) - (n + 1) / n if sum(numbers) else 0.0
    assert got == pytest.approx(want, abs=1e-8)


def test_monopoly_summary_takes_the_upper_median(spark):
    df = spark.createDataFrame([(0.1,), (0.3,), (0.5,), (0.9,)], "gini double")
    row = N.monopoly_summary(df).first()
    assert (row.clusters, row.median_gini, row.mean_gini, row.share_monopoly, row.share_distributed) == (4, 0.5, 0.45, 0.25, 0.5)


def pairs(spark, diffs, key="k"):
    return spark.createDataFrame([(key, i, 0.0, float(d)) for i, d in enumerate(diffs)], "k string, query_id bigint, baseline double, treatment double")


def ranks(spark, diffs):
    return T.signed_ranks(pairs(spark, diffs), ["k"])


def test_wilcoxon_exact(spark):
    # The classic plant heights: W = 24, p = 0.0413.
    heights = [6, 8, 14, 16, 23, 24, 28, 29, 41, -48, 49, 56, 60, -67, 75]
    row = ranks(spark, heights).first()
    assert (row.w_plus, row.w_minus, row.n_nonzero) == (96.0, 24.0, 15)
    assert T.wilcoxon(ranks(spark, heights), ["k"]).first().wilcoxon_p == pytest.approx(0.041259765625)


def test_wilcoxon_with_ties_and_zeros(spark):
    diffs = [0, 1, 1, -1, 2, 2, 3, -2, 4, 5]
    row = ranks(spark, diffs).first()
    assert (row.n_zero, row.n_nonzero, row.w_plus, row.w_minus) == (1, 9, 38.0, 7.0)
    assert row.tie_term == 24 + 24
    variance = 9 * 10 * 19 / 24 - 48 / 48
    z = (7 - 9 * 10 / 4) / math.sqrt(variance)
    assert T.wilcoxon(ranks(spark, diffs), ["k"]).first().wilcoxon_p == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_no_difference_at_all(spark):
    df = ranks(spark, [0, 0, 0])
    assert math.isnan(T.wilcoxon(df, ["k"]).first().wilcoxon_p)
    assert df.select(T.rank_biserial().alias("r")).first().r == 0.0


def test_bundle(spark):
    diffs = [0.1, 0.4, 0.2, 0.3, -0.1]
    row = T.paired_tests(pairs(spark, diffs), ["k"], with_ci=True).first()
    assert row.cohens_d == pytest.approx(np.mean(diffs) / (np.std(diffs, ddof=1) + 1e-10))
    assert row.rank_biserial == pytest.approx((13.5 - 1.5) / 15) and row.effect_size_label == "large"
    assert row.ci_low < np.mean(diffs) < row.ci_high
    few = T.paired_tests(pairs(spark, [1, 2]), ["k"]).first()
    assert few.error == "insufficient data (n<3)" and few.cohens_d is None and few.effect_size_label is None


def test_bootstrap_is_repeatable_and_close_to_numpy(spark):
    diffs = list(np.random.default_rng(1).normal(0.3, 1.0, 60))
    a, b = (T.bootstrap_ci(pairs(spark, diffs).repartition(n), ["k"]).first() for n in (1, 4))
    assert (a.ci_low, a.ci_high) == pytest.approx((b.ci_low, b.ci_high))
    rng = np.random.default_rng(2)
    means = [np.mean(rng.choice(diffs, 60)) for _ in range(4000)]
    assert (a.ci_low, a.ci_high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=0.06)


def test_verdicts(spark):
    cases = [(0.01, 0.9, None, "SUPPORTED", "gain"), (0.01, -0.9, None, "SUPPORTED", "loss"), (0.01, 0.3, None, "PARTIALLY SUPPORTED", "gain"),
             (0.08, 0.1, None, "PARTIALLY SUPPORTED", "gain"), (0.5, 0.9, None, "NOT SUPPORTED", "gain"), (None, 0.9, None, "NOT SUPPORTED (test failed)", "gain"),
             (float("nan"), 0.0, None, "NOT SUPPORTED", "none"), (None, None, "insufficient data (n<3)", "NOT SUPPORTED (insufficient data)", "none")]
    rows = T.verdict(spark.createDataFrame([c[:3] for c in cases], "wilcoxon_p double, cohens_d double, error string"))
    assert [(r.verdict, r.direction) for r in rows.collect()] == [c[3:] for c in cases]
    assert T.supported_propositions(rows).first().supported == 2


def test_step_plateau(spark):
    rows = [("A", k, min(k, 14) / 100) for k in range(1, 21)] + [("D", k, k / 100) for k in range(1, 21)]
    got = {r.condition: r.plateau_k for r in M.step_plateau(spark.createDataFrame(rows, "condition string, k int, vtp double")).collect()}
    assert got == {"A": 15, "D": None}


def test_curve_keeps_its_last_value(spark):
    rows = spark.createDataFrame([(1, "A", 1, "normative"), (1, "A", 2, "constative")], "query_id bigint, condition string, rank bigint, validity_claim_type string")
    got = {r.k: r.vtp for r in M.curve_means(M.k_curve(rows, 5), 1).collect()}
    assert got == {1: 1.0, 2: 0.5, 3: 0.5, 4: 0.5, 5: 0.5}


def test_readiness_of_an_empty_document(spark):
    docs = spark.createDataFrame([(1, "Basel"), (2, "Empty")], "document_id int, title string")
    claims = spark.createDataFrame([(10, 1, "warrant", "normative"), (11, 1, "ground", "constative")], "assertion_id int, document_id int, discourse_role string, validity_claim_type string")
    links = spark.createDataFrame([(10, 99)], "source_assertion_id int, target_assertion_id int")
    conflicts = spark.createDataFrame([(10, 11, "CONTRADICTS"), (10, 11, "DUPLICATE")], "source_assertion_id int, target_assertion_id int, relationship_type string")
    rows = {r.document_id: r for r in N.document_readiness(docs, claims, links, conflicts).collect()}
    assert rows[2].assertion_count == 0 and rows[2].ai_readiness_score == 0.2
    assert (rows[1].conflict_count, rows[1].isolated_count) == (2, 1)
    assert rows[1].ai_readiness_score == round(2 / 150 * 0.3 + 1.0 * 0.5 + 0.5 * 0.2, 3)


def test_bootstrap_draws_are_spread_over_tasks(spark):
    # A few thousand small rows, drawn a thousand times each, were all resampled by one task.
    pairs = spark.createDataFrame([(q, "p", "m", q / 7, q / 5) for q in range(40)], "query_id long, pair string, metric string, baseline double, treatment double")
    plan = T.bootstrap_ci(pairs, ["pair", "metric"])._jdf.queryExecution().optimizedPlan().toString()
    drawn = plan.index("Generate explode")
    assert "RepartitionByExpression [pair" in plan[drawn:]
    low, high = T.bootstrap_ci(pairs, ["pair", "metric"]).select("ci_low", "ci_high").first()
    mean = sum(q / 5 - q / 7 for q in range(40)) / 40
    assert low < mean < high
