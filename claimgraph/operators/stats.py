"""Paired statistics over metric tables (keys..., query_id, baseline, treatment)."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import running
from claimgraph.functions.selection import cumulative, with_medians
from claimgraph.functions.text import effect_label
from claimgraph.session import few

MIN_PAIRS = 3
EXACT_LIMIT = 50


def cohens_d(diff: Column) -> Column:
    return F.avg(diff) / (F.stddev_samp(diff) + 1e-10)


def signed_ranks(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key: counts and rank sums of the non-zero differences.

    Differences are counted per absolute value first, so tied ones share their average rank,
    and distinct values are ranked in pieces, not in one task per key.
    """
    diff = F.col("treatment") - F.col("baseline")
    counted = (pairs.withColumn("d", diff).groupBy(*keys, F.abs("d").alias("size"))
               .agg(F.count("*").alias("c"), F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down")))
    nonzero = F.when(F.col("size") > 0, F.col("c")).otherwise(0)
    ranked = cumulative(counted, keys, "size", nonzero, "smaller").withColumn("rank", F.col("smaller") + (F.col("c") + 1) / 2)
    c = F.when(F.col("size") > 0, F.col("c"))
    return (ranked.groupBy(*keys).agg(
        F.coalesce(F.sum(c), F.lit(0)).alias("n_nonzero"),
        F.coalesce(F.sum(F.when(F.col("size") == 0, F.col("c"))), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("up") * F.col("rank"))), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(F.col("size") > 0, F.col("down") * F.col("rank"))), F.lit(0.0)).alias("w_minus"),
        F.coalesce(F.sum(c * c * c - c), F.lit(0)).alias("tie_term")))


def rank_biserial() -> Column:
    n = F.col("n_nonzero")
    return F.when(n == 0, F.lit(0.0)).otherwise((F.col("w_plus") - F.col("w_minus")) / (n * (n + 1) / 2 + 1e-10))


def wilcoxon_p(n: int, zeros: int, w_plus: float, w_minus: float, tie_term: float) -> float:
    """Two-sided signed-rank p value from the rank sums.

    Exact for up to fifty differences without zeros or ties, else the normal
    approximation with tie correction; no difference at all gives NaN.
    """
    if n == 0:
        return math.nan
    smaller = min(w_plus, w_minus)
    if n <= EXACT_LIMIT and zeros == 0 and tie_term == 0:
        counts = np.zeros(n * (n + 1) // 2 + 1)
        counts[0] = 1.0
        for rank in range(1, n + 1):
            counts[rank:] += counts[:-rank].copy()
        return float(min(1.0, 2.0 * counts[: int(smaller) + 1].sum() / 2.0 ** n))
    variance = n * (n + 1) * (2 * n + 1) / 24.0 - tie_term / 48.0
    if variance <= 0:
        return math.nan
    z = (smaller - n * (n + 1) / 4.0) / math.sqrt(variance)
    return math.erfc(abs(z) / math.sqrt(2.0))


def wilcoxon(ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p value per key; the rank sums are one row per key, so Python sees only those."""
    cols = ["n_nonzero", "n_zero", "w_plus", "w_minus", "tie_term"]

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [wilcoxon_p(int(r["n_nonzero"]), int(r["n_zero"]), float(r["w_plus"]), float(r["w_minus"]), float(r["tie_term"]))
                 for r in batch.select(cols).to_pylist()]
            # Arrow keeps NaN apart from null.
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(p, pa.float64(), from_pandas=False)],
                                             names=[*keys, "wilcoxon_p"])

    schema = ", ".join(f"{k} {dict(ranks.dtypes)[k]}" for k in keys) + ", wilcoxon_p double"
    return ranks.select(*keys, *cols).mapInArrow(values, schema)


def _draw(*parts: Column | str) -> Column:
    """A number below 2**60 from the digest of the parts joined by bars."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 15), 16, 10).cast("bigint")


def _tasks(df: DataFrame) -> int:
    """At least a task per core, and as many as the session shuffles to."""
    return max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def bootstrap_ci(pairs: DataFrame, keys: Sequence[str], draws: int = 1000, seed: int = 7) -> DataFrame:
    """95 % interval of the mean difference from seeded resamples.

    A digest of (seed, keys, draw, position) picks each resampled row, so a retried task
    and any other engine repeat its draws.  Picks meet the rows they name; the sums are
    plain aggregates.  Differences count in billionths and sums, interpolation and rounding to
    millionths are whole numbers, so the interval does not depend on the order of additions.
    """
    billionths = F.round((F.col("treatment") - F.col("baseline")) * 1e9).cast("bigint")
    numbered = running(pairs.withColumn("d", billionths), list(keys), [F.col("query_id")], F.floor(F.col("query_id") / 65_536), {"i": F.lit(1)})
    rows = few(numbered.select(*keys, "i", "d"))
    sizes = pairs.groupBy(*keys).agg(F.count("*").alias("size"))
    # Small rows with much work each: the number of tasks is named, or the planner would put all of them into one by their bytes.
    slots = (rows.select(*keys, F.col("i").alias("slot")).join(sizes, list(keys)).repartition(_tasks(pairs), *keys, "slot")
             .withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))))
    picks = slots.withColumn("i", F.pmod(_draw(F.lit(seed), *keys, "draw", "slot"), F.col("size")) + 1)
    sums = (picks.join(rows, [*keys, "i"])
            .groupBy(*keys, "draw").agg(F.sum("d").alias("total"), F.count("*").alias("size")))
    # One number per draw and key, so the list is as long as there are draws.
    ordered = sums.groupBy(*keys).agg(F.array_sort(F.collect_list("total")).alias("totals"), F.first("size").alias("size"))

    def quantile(permille: int) -> Column:
        at, part = divmod((draws - 1) * permille, 1000)
        low, high = (F.get("totals", F.lit(min(k, draws - 1))).cast("decimal(20,0)") for k in (at, at + 1))
        over, under = low * (1000 - part) + high * part, F.col("size").cast("decimal(18,0)") * 1_000_000
        whole = F.call_function("div", F.abs(over) * 2 + under, under * 2)
        return F.when(over < 0, -whole).otherwise(whole) / 1e6

    return ordered.select(*keys, quantile(25).alias("ci_low"), quantile(975).alias("ci_high"))


def paired_tests(pairs: DataFrame, keys: Sequence[str], with_p: bool = True, with_ci: bool = False) -> DataFrame:
    """The whole bundle per key; fewer than three pairs give an error text and no statistics."""
    keys = list(keys)
    diff = F.col("treatment") - F.col("baseline")
    basics = pairs.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"), F.avg("baseline").alias("mean_baseline"), F.avg("treatment").alias("mean_treatment"),
        cohens_d(diff).alias("cohens_d"))
    basics = with_medians(basics, pairs, keys, {"median_baseline": "baseline", "median_treatment": "treatment"})
    ranks = signed_ranks(pairs, keys)
    out = basics.join(ranks.withColumn("rank_biserial", rank_biserial()).select(*keys, "rank_biserial"), keys)
    if with_p:
        out = out.join(wilcoxon(ranks, keys), keys)
    if with_ci:
        out = out.join(bootstrap_ci(pairs, keys), keys)
    enough = F.col("n_pairs") >= MIN_PAIRS
    measured = [c for c in out.columns if c not in keys and c != "n_pairs"]
    return out.select(*keys, "n_pairs", *[F.when(enough, F.col(c)).alias(c) for c in measured],
                      F.when(enough, effect_label(F.col("cohens_d"))).alias("effect_size_label"),
                      F.when(~enough, "insufficient data (n<3)").alias("error"))


def verdict(tests: DataFrame) -> DataFrame:
    """Support for a proposition from p and effect size, with the direction of the effect beside it."""
    p, d = F.col("wilcoxon_p"), F.abs(F.coalesce("cohens_d", F.lit(0.0)))
    known = p.isNotNull() & ~F.isnan(p)
    text = (F.when(F.col("error").isNotNull(), "NOT SUPPORTED (insufficient data)")
            .when(p.isNull(), "NOT SUPPORTED (test failed)")
            .when(known & (p < 0.05) & (d >= 0.5), "SUPPORTED")
            .when(known & (p < 0.05) & (d >= 0.2), "PARTIALLY SUPPORTED")
            .when(known & (p < 0.1), "PARTIALLY SUPPORTED").otherwise("NOT SUPPORTED"))
    direction = F.when(F.col("cohens_d") > 0, "gain").when(F.col("cohens_d") < 0, "loss").otherwise("none")
    return tests.withColumn("verdict", text).withColumn("direction", direction)


def supported_propositions(verdicts: DataFrame) -> DataFrame:
    """How many verdicts start with SUPPORTED."""
    return verdicts.agg(F.count_if(F.startswith(F.col("verdict"), F.lit("SUPPORTED"))).alias("supported"), F.count("*").alias("propositions"))


# Functions of this module travel to the workers whole, so they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
