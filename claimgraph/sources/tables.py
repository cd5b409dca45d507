"""Keyed inserts and updates on tables kept as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key


def new_rows(incoming: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows of ``incoming`` whose key is new, the first per key; append them to the table."""
    first = top_per_key(incoming, list(key), list(order), 1)
    return first.join(existing.select(*key), list(key), "left_anti")


def update_column(table: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """The table with ``column`` taken from ``updates`` (key, new value) where present.

    ``updates`` must hold each key at most once; write the result as a new version.
    """
    changed = updates.select(key, F.col(column).alias("_new"))
    return (table.join(changed, key, "left")
            .withColumn(column, F.coalesce("_new", column)).drop("_new"))


def with_seeds(queries: DataFrame, seeds: DataFrame) -> DataFrame:
    """Queries with their stored seed kept and missing seeds filled in."""
    found = seeds.select("query_id", F.col("assertion_id").cast("string").alias("_seed"))
    return (queries.join(found, "query_id", "left")
            .withColumn("query_seed_assertion_id", F.coalesce("query_seed_assertion_id", "_seed")).drop("_seed"))
