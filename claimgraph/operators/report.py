"""The nested result document of an evaluation run.

Its parts are small summaries (conditions, pairs, metrics, subgroups and k values).  The list of
failed queries grows with the queries, so the document holds their number and they stay a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEST_FIELDS = ["n_pairs", "mean_baseline", "mean_treatment", "median_baseline", "median_treatment", "wilcoxon_p", "cohens_d",
               "rank_biserial", "ci_95", "effect_size_label", "error"]


def nest(rows: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """One row with column ``nested``: a map per key inside the map of the key before it; null without rows.

    Key combinations must be distinct and few, as those of a summary are.
    """
    out = rows.select(*keys, value.alias("nested"))
    for depth in range(len(keys) - 1, -1, -1):
        entry = F.struct(F.col(keys[depth]).cast("string").alias("k"), F.col("nested"))
        out = out.groupBy(*keys[:depth]).agg(F.map_from_entries(F.collect_list(entry)).alias("nested"))
    return out


def _curve(points: DataFrame, value: str) -> DataFrame:
    """Per condition the points of a curve in order of k."""
    per = points.groupBy("condition").agg(F.array_sort(F.collect_list(F.struct(F.col("k").cast("bigint").alias("k"), F.col(value).alias("value")))).alias("points"))
    return nest(per, ["condition"], F.col("points"))


def nested_results(queries: DataFrame, failed: DataFrame, summary: DataFrame, tests: DataFrame, by_type: DataFrame,
                   by_repetitiveness: DataFrame, precision_curve: DataFrame, conflict_curve: DataFrame) -> DataFrame:
    """One row: counts, query distribution, results by condition, paired tests, both subgroups and the k-curves.

    ``failed`` is (query_id, error); ``summary`` (condition, metric, mean, median, n); the tests are
    bundles of ``stats.paired_tests`` with p and interval, by (pair, metric), (epistemic_type,
    pair, metric) and (stratum, pair, metric); curves are (condition, k, vtp) and
    (condition, k, csr).  A part without rows is an empty map.
    """
    def part(rows: DataFrame) -> Column:
        return rows.select(F.coalesce("nested", F.create_map().cast(rows.schema["nested"].dataType))).scalar()

    def bundle(rows: DataFrame, keys: Sequence[str]) -> Column:
        with_interval = rows.withColumn("ci_95", F.when(F.col("ci_low").isNotNull(), F.array("ci_low", "ci_high")))
        return part(nest(with_interval, keys, F.struct(*TEST_FIELDS)))

    distribution = queries.groupBy("epistemic_type").agg(F.count("*").alias("n"))
    return queries.sparkSession.range(1).select(
        queries.agg(F.count("*")).scalar().alias("n_queries"),
        failed.agg(F.count("*")).scalar().alias("n_failed"),
        part(nest(distribution, ["epistemic_type"], F.col("n"))).alias("query_distribution"),
        part(nest(summary, ["condition", "metric"], F.struct("mean", "median", "n"))).alias("results_by_condition"),
        bundle(tests, ["pair", "metric"]).alias("statistical_tests"),
        bundle(by_type, ["epistemic_type", "pair", "metric"]).alias("subgroup_by_epistemic_type"),
        bundle(by_repetitiveness, ["stratum", "pair", "metric"]).alias("subgroup_by_repetitiveness"),
        F.struct(part(_curve(precision_curve, "vtp")).alias("vtp_normative"),
                 part(_curve(conflict_curve, "csr")).alias("csr_by_k")).alias("k_invariance_curves"))


def flat_results(document: DataFrame) -> DataFrame:
    """The document in rows (section, subgroup, key, metric, n, first, second)."""
    def level(rows: DataFrame, column: str, name: str) -> DataFrame:
        return rows.select(*[c for c in rows.columns if c != column], F.explode(column).alias(name, "v"))

    def section(name: str, column: str, keys: Sequence[str], n: str, first: str | None, second: str | None) -> DataFrame:
        rows = document.select(F.col(column).alias("v"))
        for key in keys:
            rows = level(rows, "v", key)
        at = {key: F.col(key) for key in keys}
        number = lambda path: F.lit(None).cast("double") if path is None else F.col(path)
        text = lambda key: at.get(key, F.lit("")).alias(key)
        return rows.select(F.lit(name).alias("section"), text("subgroup"), text("key"), text("metric"),
                           F.col(n).cast("bigint").alias("n"), number(first).alias("first"), number(second).alias("second"))

    def curve(name: str) -> DataFrame:
        rows = document.select(F.explode(f"k_invariance_curves.{name}").alias("key", "points")).select("key", F.explode("points").alias("p"))
        return rows.select(F.lit("curve").alias("section"), F.lit("").alias("subgroup"), "key", F.lit(name).alias("metric"),
                           F.col("p.k").alias("n"), F.col("p.value").alias("first"), F.lit(None).cast("double").alias("second"))

    counts = [document.select(F.lit("run").alias("section"), F.lit("").alias("subgroup"), F.lit(name).alias("key"), F.lit("").alias("metric"),
                              F.col(name).alias("n"), F.lit(None).cast("double").alias("first"), F.lit(None).cast("double").alias("second"))
              for name in ("n_queries", "n_failed")]
    parts = [*counts, section("distribution", "query_distribution", ["key"], "v", None, None),
             section("condition", "results_by_condition", ["key", "metric"], "v.n", "v.mean", "v.median"),
             section("tests", "statistical_tests", ["key", "metric"], "v.n_pairs", "v.wilcoxon_p", "v.cohens_d"),
             section("type", "subgroup_by_epistemic_type", ["subgroup", "key", "metric"], "v.n_pairs", "v.wilcoxon_p", "v.cohens_d"),
             section("repetitiveness", "subgroup_by_repetitiveness", ["subgroup", "key", "metric"], "v.n_pairs", "v.wilcoxon_p", "v.cohens_d"),
             curve("vtp_normative"), curve("csr_by_k")]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out
