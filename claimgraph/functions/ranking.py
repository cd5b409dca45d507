"""Ranks and running sums that survive hot keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                rank: str | None = None) -> DataFrame:
    """The first ``k`` rows per key.

    The rank filter lets the planner cut every map task to ``k`` rows per key
    before the shuffle, so a key with a third of all rows sends at most ``k``
    rows per task.
    """
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.where(F.col(name) <= k)
    return kept if rank else kept.drop(name)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
            totals: dict[str, Column]) -> DataFrame:
    """Running sums within a key in two levels, so that no key is sorted by one task.

    ``bucket`` must not decrease along ``order`` and is small enough to sort in
    one task.  Rows are summed inside their bucket; buckets (few) are summed per
    key, and each row adds what the buckets before it hold.  ``totals`` maps an
    output name to the Column to add up; ``F.lit(1)`` gives a row number.
    """
    marked = df.withColumn("_bucket", bucket)
    for name, value in totals.items():
        marked = marked.withColumn(f"_v_{name}", value)
    by_bucket = (marked.groupBy(*keys, "_bucket")
                 .agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in totals]))
    buckets = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = by_bucket.select(*keys, "_bucket", *[
        F.coalesce(F.sum(f"_s_{n}").over(buckets), F.lit(0)).alias(f"_b_{n}") for n in totals])
    inside = (Window.partitionBy(*keys, "_bucket").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = marked
    for n in totals:
        local = local.withColumn(n, F.sum(f"_v_{n}").over(inside))
    joined = local.join(before, [*keys, "_bucket"])
    for n in totals:
        joined = joined.withColumn(n, F.col(n) + F.col(f"_b_{n}"))
    return joined.drop("_bucket", *[f"_v_{n}" for n in totals], *[f"_b_{n}" for n in totals])


def sort_bucket(value: Column, width: int) -> Column:
    """A bucket that grows with an integer order value."""
    return F.floor(value / width)
