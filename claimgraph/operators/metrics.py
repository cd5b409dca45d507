"""Evaluation of ranked results: precision, completeness, efficiency, conflicts and k-curves.

Results are long tables (query_id, epistemic_type, condition, rank, vtp_rank,
assertion_id, validity_claim_type); metrics are (query_id, epistemic_type,
condition, metric, value).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.ranking import running
from claimgraph.functions.selection import median, middle
from claimgraph.operators import retrieval as R

CONDITIONS = ["A", "B", "C", "D", "E"]
MAX_K = 50
COVERAGE = 0.8
# The pairs of conditions that are compared.
PAIRS = [("A", "D"), ("B", "D"), ("C", "D"), ("A", "E"), ("B", "E"), ("C", "E"), ("D", "E")]
# The k values of the padded curve.
CURVE_KS = [1, 2, 3, 5, 8, 10, 15, 20, 30, 50, 75, 100]


def grid(queries: DataFrame, conditions: Sequence[str] = CONDITIONS) -> DataFrame:
    return queries.select("query_id", "epistemic_type", F.explode(F.array(*[F.lit(c) for c in conditions])).alias("condition"))


def validity_precision(results: DataFrame, cells: DataFrame, k: int = 10) -> DataFrame:
    """Share of the wanted type among the first ``k``; mixed queries need both types; nothing found is 0."""
    kind = F.col("validity_claim_type")
    found = results.where(F.col("vtp_rank") <= k).groupBy("query_id", "condition").agg(
        F.avg(F.when(kind == "normative", 1.0).otherwise(0.0)).alias("n"),
        F.avg(F.when(kind == "constative", 1.0).otherwise(0.0)).alias("c"))
    want = F.col("epistemic_type")
    value = (F.when(want == "normative", F.col("n")).when(want == "constative", F.col("c"))
             .otherwise(((F.col("n") > 0) & (F.col("c") > 0)).cast("double")))
    return (cells.join(found, ["query_id", "condition"], "left")
            .select("query_id", "epistemic_type", "condition", F.lit("vtp").alias("metric"), F.coalesce(value, F.lit(0.0)).alias("value")))


def precision_over_all(results: DataFrame, cells: DataFrame) -> DataFrame:
    """Share of the wanted type among everything found; mixed queries always score 1."""
    found = (results.join(cells.select("query_id", "condition", "epistemic_type"), ["query_id", "condition"])
             .groupBy("query_id", "condition").agg(F.avg(F.when(
                 (F.col("epistemic_type") == "mixed") | (F.col("validity_claim_type") == F.col("epistemic_type")), 1.0)
                 .otherwise(0.0)).alias("value")))
    return (cells.join(found, ["query_id", "condition"], "left")
            .select("query_id", "epistemic_type", "condition", F.coalesce("value", F.lit(0.0)).alias("value")))


def coverage(results: DataFrame, neighborhood: DataFrame, cells: DataFrame, max_k: int = MAX_K) -> DataFrame:
    """Argumentative completeness (ac, null without a neighbourhood) and the least k that covers 80 % of it (cwe).

    Only results inside the neighbourhood are ranked; their ranks are counted in
    two levels, as a neighbourhood may be very large.
    """
    sizes = neighborhood.groupBy("query_id").agg(F.count("*").alias("size"))
    inside = results.select("query_id", "condition", "rank", "assertion_id").join(neighborhood, ["query_id", "assertion_id"])
    counted = running(inside, ["query_id", "condition"], [F.col("rank")], F.floor(F.col("rank") / 65_536), {"hits": F.lit(1)})
    reached = counted.join(sizes, "query_id").groupBy("query_id", "condition").agg(
        F.count("*").alias("hits"), F.min(F.when(F.col("hits") / F.col("size") >= COVERAGE, F.col("rank"))).alias("least_k"))
    joined = cells.join(sizes, "query_id", "left").join(reached, ["query_id", "condition"], "left")
    ac = F.when(F.col("size").isNotNull(), F.coalesce("hits", F.lit(0)) / F.col("size"))
    cwe = F.coalesce(F.col("least_k"), F.lit(max_k)).cast("double")
    both = F.explode(F.array(F.struct(F.lit("ac").alias("metric"), ac.alias("value")),
                             F.struct(F.lit("cwe").alias("metric"), cwe.alias("value"))))
    return joined.select("query_id", "epistemic_type", "condition", both.alias("m")).select(
        "query_id", "epistemic_type", "condition", "m.metric", "m.value")


def structural_conflicts(cells: DataFrame, flags: DataFrame) -> DataFrame:
    """1 where the condition itself reports a contradiction; conditions without ``flags`` score 0."""
    return (cells.join(flags.select("query_id", "condition", "conflicts_detected"), ["query_id", "condition"], "left")
            .select("query_id", "epistemic_type", "condition", F.lit("csr").alias("metric"),
                    F.coalesce(F.col("conflicts_detected").cast("int"), F.lit(0)).cast("double").alias("value")))


def passive_conflicts(results: DataFrame, conflicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Which groups of results hold both ends of an open CONTRADICTS row."""
    kept = conflicts.where("relationship_type = 'CONTRADICTS' and review_status <> 'false_positive'").select(
        F.col("source_assertion_id").alias("src"), F.col("target_assertion_id").alias("dst"))
    ids = results.select(*keys, "assertion_id").distinct()
    return (ids.withColumnRenamed("assertion_id", "src").join(kept, "src")
            .join(ids.withColumnRenamed("assertion_id", "dst"), [*keys, "dst"], "left_semi")
            .select(*keys).distinct())


def summarize(metrics: DataFrame, keys: Sequence[str] = ("condition", "metric")) -> DataFrame:
    return middle(metrics, keys, "value").select(
        *keys, F.round("mean", 9).alias("mean"), F.round(median(), 9).alias("median"), "n")


def paired(metrics: DataFrame, pairs: Sequence[tuple[str, str]] = tuple(PAIRS), extra: Sequence[str] = ()) -> DataFrame:
    """Baseline and treatment scores of each query for each pair, where both exist.

    One pivot by (query, metric) replaces a self-join per pair.
    """
    names = sorted({c for pair in pairs for c in pair})
    wide = metrics.groupBy("query_id", "epistemic_type", "metric", *extra).pivot("condition", names).agg(F.first("value"))
    options = F.explode(F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(a).alias("baseline"), F.col(b).alias("treatment"))
                                  for a, b in pairs]))
    return (wide.select("query_id", "epistemic_type", "metric", *extra, options.alias("p"))
            .select("query_id", "epistemic_type", "metric", *extra, "p.*")
            .where("baseline is not null and treatment is not null"))


def k_curve(results: DataFrame, max_k: int = 100) -> DataFrame:
    """Precision after each k from one ranking; beyond the last result the value stays.

    ``results`` holds normative queries, at most ``max_k`` rows per query and condition.
    """
    order = Window.partitionBy("query_id", "condition").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("query_id", "condition")
    hit = F.when(F.col("validity_claim_type") == "normative", 1).otherwise(0)
    at = (results.withColumn("hits", F.sum(hit).over(order)).withColumn("last", F.max("rank").over(whole))
          .withColumn("upto", F.when(F.col("rank") == F.col("last"), F.lit(max_k)).otherwise(F.col("rank")).cast("int"))
          .withColumn("k", F.explode(F.sequence(F.col("rank").cast("int"), F.col("upto")))))
    return (at.groupBy("condition", "k").agg(F.round(F.sum(F.col("hits") / F.col("rank")), 9).alias("total"), F.count("*").alias("n")))


def curve_means(curve: DataFrame, n_queries: int | Column) -> DataFrame:
    """Mean over all queries; a query without results adds 0."""
    n = F.lit(n_queries) if isinstance(n_queries, int) else n_queries
    return curve.select("condition", "k", F.round(F.col("total") / n, 6).alias("vtp"))


def step_plateau(means: DataFrame, first_k: int = 11, step: float = 0.005) -> DataFrame:
    """The first k from 11 on at which a curve moves by less than the step; null if none."""
    before = F.lag("vtp").over(Window.partitionBy("condition").orderBy("k"))
    moved = means.withColumn("moved", F.abs(F.col("vtp") - before))
    return moved.groupBy("condition").agg(
        F.min(F.when((F.col("k") >= first_k) & (F.col("moved") < step), F.col("k"))).alias("plateau_k"))


def padded_curve(found: DataFrame, assertions: DataFrame, queries: DataFrame, ks: Sequence[int] = tuple(CURVE_KS)) -> DataFrame:
    """Mean share of normative assertions at each k: plain search against padded gated search.

    ``found`` needs twice the largest k of plain results.  All k come from one search.
    """
    k = F.explode(F.array(*[F.lit(v) for v in ks]))
    normative = queries.where("epistemic_type = 'normative'").select("query_id")
    types = assertions.select("assertion_id", "validity_claim_type")
    rows = found.where("want in (0, 1)").join(normative, "query_id", "left_semi").select("query_id", "want", "rank", "assertion_id", k.alias("k"))
    plain = rows.where("want = 0 and rank <= 2 * k")
    gated = rows.where("want = 1 and rank <= k")
    a = plain.where("rank <= k").select("query_id", "k", "assertion_id", F.lit("A").alias("condition"))
    extra = plain.join(gated.select("query_id", "k", "assertion_id"), ["query_id", "k", "assertion_id"], "left_anti")
    filled = gated.withColumn("tier", F.lit(0)).unionByName(extra.withColumn("tier", F.lit(1)))
    place = F.row_number().over(Window.partitionBy("query_id", "k").orderBy("tier", "rank"))
    d = (filled.withColumn("place", place).where("place <= k")
         .select("query_id", "k", "assertion_id", F.lit("D").alias("condition")))
    share = (a.unionByName(d).join(types, "assertion_id").groupBy("query_id", "k", "condition")
             .agg(F.avg(F.when(F.col("validity_claim_type") == "normative", 1.0).otherwise(0.0)).alias("vtp")))
    return share.groupBy("condition", "k").agg(F.round(F.avg("vtp"), 4).alias("vtp"))


def curve_summary(curve: DataFrame) -> DataFrame:
    """First k at which A reaches 90 % of its maximum, that maximum, and the gap to D at k = 100."""
    peak = curve.where("condition = 'A'").agg(F.max("vtp")).scalar()
    a = F.col("condition") == "A"
    last_d = F.max(F.when((F.col("condition") == "D") & (F.col("k") == 100), F.col("vtp")))
    last_a = F.max(F.when(a & (F.col("k") == 100), F.col("vtp")))
    return (curve.withColumn("peak", peak).agg(
        F.min(F.when(a & (F.col("vtp") >= 0.90 * F.col("peak")), F.col("k"))).alias("plateau_k"),
        F.round(F.max("peak"), 4).alias("plateau_vtp"), F.round(last_d - last_a, 4).alias("gap_at_100")))


def conflict_curve(queries: DataFrame, vectors: DataFrame, assertions: DataFrame, edges: DataFrame, conflicts: DataFrame,
                   ks: Sequence[int] = (5, 10, 20, 50, 100)) -> DataFrame:
    """Share of queries whose chunk-based results hold a contradiction, at each number of chunks.

    One search at the largest k serves all: (query, k) acts as a query of its own.
    """
    top = R.top_chunks(queries, vectors, max(ks))
    keyed = (top.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("rank <= k")
             .select((F.col("query_id") * 1000 + F.col("k")).alias("query_id"), "chunk_id", "rank"))
    a = R.condition_a_v1(keyed, assertions)
    b = R.condition_b_v1(keyed, assertions, edges)
    results = (a.select("query_id", "assertion_id").withColumn("condition", F.lit("A"))
               .unionByName(b.select("query_id", "assertion_id").withColumn("condition", F.lit("B"))))
    hits = passive_conflicts(results, conflicts, ["query_id", "condition"])
    cells = queries.select("query_id", F.explode(F.array(*[
        F.struct(F.lit(c).alias("condition"), F.lit(k).alias("k")) for c in "AB" for k in ks])).alias("g"))
    cells = cells.select((F.col("query_id") * 1000 + F.col("g.k")).alias("query_id"), "g.condition", "g.k")
    return (cells.join(hits.withColumn("hit", F.lit(1.0)), ["query_id", "condition"], "left")
            .groupBy("condition", "k").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("csr")))


def rates(metrics: DataFrame, cross_source: DataFrame, queries: DataFrame) -> DataFrame:
    """Eligible and excluded queries, conflict rates of D and E, cross-source conflict rate of D.

    ``cross_source`` is (query_id): queries whose D results contradict across sources.
    """
    marked = queries.select("query_id").join(cross_source.select("query_id").distinct().withColumn("cross", F.lit(1.0)), "query_id", "left")
    cross = marked.agg(F.round(F.avg(F.coalesce("cross", F.lit(0.0))), 6)).scalar()
    is_ac = (F.col("metric") == "ac") & (F.col("condition") == "A")
    csr = lambda c: F.round(F.avg(F.when((F.col("metric") == "csr") & (F.col("condition") == c), F.col("value"))), 6)
    return metrics.agg(F.count_if(is_ac & F.col("value").isNotNull()).alias("ac_eligible"),
                       F.count_if(is_ac & F.col("value").isNull()).alias("ac_excluded"),
                       csr("D").alias("csr_d_rate"), csr("E").alias("csr_e_rate")).withColumn("cross_source_rate", cross)


def side_by_side(summary: DataFrame, corpora: tuple[str, str]) -> DataFrame:
    """Means of two corpora per condition and metric; ``summary`` has ``corpus``."""
    left, right = (summary.where(F.col("corpus") == name).select("condition", "metric", F.col("mean").alias(f"{name}_mean"))
                   for name in corpora)
    return left.join(right, ["condition", "metric"], "full_outer")
