"""Middle values by counting, against sorting."""

import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.functions import selection
from claimgraph.functions.selection import cumulative, median, middle, with_medians


def expected(values):
    ordered = sorted(values)
    return len(ordered), ordered[(len(ordered) - 1) // 2], ordered[len(ordered) // 2]


@settings(max_examples=15, deadline=None)
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-4, 4).map(float), st.floats(-1e9, 1e9))),
                     min_size=1, max_size=60))
def test_middle_equals_sorting(spark, rows):
    got = {r.k: (r.n, r.low, r.high) for r in middle(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    want = {k: expected([v for c, v in rows if c == k and v is not None]) for k in {c for c, v in rows if v is not None}}
    assert got == want


@pytest.mark.parametrize("n", [1, 2, 999, 5000])
def test_many_distinct_values_and_one_with_a_third_of_the_rows(spark, n):
    values = [((i * 7919) % n) / 3 for i in range(n)] + [0.25] * (n // 2)
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(5)
    row = middle(frame, [], "v").first()
    assert (row.n, row.low, row.high) == expected(values)
    assert middle(frame, [], "v").select(median()).first()[0] == pytest.approx(statistics.median(values), rel=1e-15)


def test_a_key_is_ranked_by_pieces_only(spark):
    frame = spark.range(100_000).selectExpr("id % 2 as k", "cast(hash(id) as double) as v")
    plan = middle(frame, ["k"], "v")._jdf.queryExecution().executedPlan().toString().lower()
    assert "median(" not in plan and " percentile(" not in plan
    assert "windowspecdefinition(key" in plan and "windowspecdefinition(key, v" not in plan.replace("#", "").replace("`", "")
    assert selection.PIECES == 64


def test_no_values(spark):
    frame = spark.createDataFrame([("a", None)], "k string, v double")
    assert middle(frame, ["k"], "v").count() == 0
    summary = frame.select("k").distinct()
    assert [tuple(r) for r in with_medians(summary, frame, ["k"], {"m": "v"}).collect()] == [("a", None)]


def test_medians_beside_a_summary(spark):
    frame = spark.createDataFrame([("a", 1.0, 5.0), ("a", 2.0, None), (None, 4.0, 7.0), ("a", 9.0, 6.0)], "k string, x double, y double")
    rows = with_medians(frame.groupBy("k").count(), frame, ["k"], {"mx": "x", "my": "y"}).collect()
    assert sorted(((r.k, r["count"], r.mx, r.my) for r in rows), key=repr) == [("a", 3, 2.0, 5.5), (None, 1, 4.0, 7.0)]


def test_sums_before_each_value(spark):
    rows = [(k, float(v * v % 1009), v % 5) for k in ("a", None) for v in range(500)]
    distinct = {(k, v): c for k, v, c in rows}
    frame = spark.createDataFrame([(k, v, c) for (k, v), c in distinct.items()], "k string, v double, c int").repartition(6)
    got = {(r.k, r.v): r.before for r in cumulative(frame, ["k"], "v", F.col("c"), "before").collect()}
    assert got == {(k, v): sum(c for (k2, w), c in distinct.items() if k2 == k and w < v) for k, v in distinct}
