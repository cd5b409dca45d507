"""Exact middle values and running sums over any number of values, without sorting a key's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.session import cut_lineage

#: Pieces that a key's values are cut into; only the pieces that hold a middle value are sorted.
PIECES = 64


def middle(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys..., n, mean, low, high): the number of non-null values per key, their mean, and the lower and upper middle one.

    The middle ones are the same where n is odd.  Equal values are counted first.  Cuts from a mergeable sketch, which
    only have to be even, deal the distinct values into pieces; the counts of the pieces, few per key, say
    which pieces hold the middle ranks, and only those are ranked value by value.  Keys without a value
    give no row; NaN is above all numbers; a null key is a key.
    """
    key = F.struct(*[F.col(f"`{k}`") for k in keys], F.lit(0).alias("one"))
    counted = cut_lineage(rows.where(F.col(value).isNotNull()).groupBy(key.alias("key"), F.col(value).alias("v"))
                          .agg(F.count("*").alias("c")))
    cuts = counted.groupBy(F.col("key").alias("same")).agg(
        F.percentile_approx("v", [k / PIECES for k in range(1, PIECES)], 20 * PIECES).alias("cuts"), F.sum("c").alias("n"),
        (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean"))
    dealt = counted.join(cuts, F.col("key").eqNullSafe(F.col("same"))).select(
        "key", "v", "c", "n", "mean", F.size(F.filter("cuts", lambda cut: cut < F.col("v"))).alias("piece"))
    earlier = Window.partitionBy("key").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    first, last = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    pieces = (dealt.groupBy("key", "piece").agg(F.sum("c").alias("size"), F.first("n").alias("n"))
              .withColumn("before", F.coalesce(F.sum("size").over(earlier), F.lit(0)))
              .where((F.col("before") < last) & (F.col("before") + F.col("size") >= first))
              .select(F.col("key").alias("k"), F.col("piece").alias("p"), "before"))
    held = dealt.join(pieces, F.col("key").eqNullSafe(F.col("k")) & (F.col("piece") == F.col("p")))
    inside = Window.partitionBy("key", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = held.withColumn("upto", F.col("before") + F.sum("c").over(inside))
    return ranked.groupBy("key").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.min(F.when(F.col("upto") >= first, F.col("v"))).alias("low"),
        F.min(F.when(F.col("upto") >= last, F.col("v"))).alias("high")).select(
        *[F.col("key").getField(k).alias(k) for k in keys], "n", "mean", "low", "high")


def cumulative(rows: DataFrame, keys: Sequence[str], value: str, amount: Column, name: str) -> DataFrame:
    """``rows`` and ``name``: the sum of ``amount`` over the rows of the same keys with a smaller ``value``, 0 for the first.

    A value stands once per key.  Pieces are dealt as in ``middle``; a row adds what the pieces before its own
    hold, few per key, to what its piece holds before it.
    """
    rows = cut_lineage(rows.select(F.struct("*").alias("row"), F.struct(*keys, F.lit(0).alias("one")).alias("key"),
                                   F.col(value).alias("v"), amount.alias("amount")))
    cuts = rows.groupBy(F.col("key").alias("same")).agg(
        F.percentile_approx("v", [k / PIECES for k in range(1, PIECES)], 20 * PIECES).alias("cuts"))
    dealt = rows.join(cuts, F.col("key").eqNullSafe(F.col("same"))).select(
        "row", "key", "v", "amount", F.size(F.filter("cuts", lambda cut: cut < F.col("v"))).alias("piece"))
    earlier = Window.partitionBy("k").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    pieces = (dealt.groupBy(F.col("key").alias("k"), F.col("piece").alias("p")).agg(F.sum("amount").alias("size"))
              .select("k", "p", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("pieces_before")))
    inside = Window.partitionBy("key", "piece").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("before", F.coalesce(F.sum("amount").over(inside), F.lit(0)))
    return (summed.join(pieces, F.col("key").eqNullSafe(F.col("k")) & (F.col("piece") == F.col("p")))
            .select("row.*", (F.col("before") + F.col("pieces_before")).alias(name)))


def median(low: Column | str = "low", high: Column | str = "high") -> Column:
    """The mean of the two middle values."""
    low, high = (F.col(c) if isinstance(c, str) else c for c in (low, high))
    return low + (high - low) / 2


def with_medians(summary: DataFrame, rows: DataFrame, keys: Sequence[str], values: dict[str, str]) -> DataFrame:
    """``summary`` (a row per key) and a median column for each entry name: column of ``values``."""
    long = rows.select(*keys, F.explode(F.array(*[F.struct(F.lit(name).alias("of"), F.col(column).cast("double").alias("v"))
                                                  for name, column in values.items()])).alias("m")).select(*keys, "m.*")
    found = middle(long, [*keys, "of"], "v").groupBy(F.struct(*keys).alias("same")).pivot("of", list(values)).agg(F.first(median()))
    return summary.join(found, F.struct(*[F.col(k) for k in keys]).eqNullSafe(F.col("same")), "left").drop("same")
