"""Numbers for text ids.

Readers and parsers give text ids; search, ranks and edges work on 64-bit numbers.  A
stored table maps one to the other.  Numbers ascend like the ids, so ties that go to
the smaller id fall the same way for both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.session import cut_lineage


def number_ids(*columns: DataFrame) -> DataFrame:
    """(id, number): every distinct non-null id of the given one-column tables, numbered in ascending order.

    Ids are dealt by range and sorted inside their task; the number is the task's place
    and the row's.  The table is written once, so a number never changes.
    """
    ids = None
    for column in columns:
        part = column.toDF("id")
        ids = part if ids is None else ids.unionByName(part)
    dealt = ids.where("id is not null").distinct().repartitionByRange("id").sortWithinPartitions("id")
    return cut_lineage(dealt.withColumn("number", F.monotonically_increasing_id()))


def encode(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the numbers of the text ids in ``columns``; an unknown id becomes null."""
    return _swap(df, ids.select(F.col("id").alias("_from"), F.col("number").alias("_to")), columns)


def decode(df: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The inverse of ``encode``."""
    return _swap(df, ids.select(F.col("number").alias("_from"), F.col("id").alias("_to")), columns)


def _swap(df: DataFrame, pairs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    order = df.columns
    for column in columns:
        df = df.join(pairs, df[column] == pairs["_from"], "left").drop(column, "_from").withColumnRenamed("_to", column)
    return df.select(*order)
