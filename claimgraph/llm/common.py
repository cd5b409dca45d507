"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, breaks: str) -> Column:
    """Runs of characters outside ``breaks``; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), breaks), "")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also where ``use`` refers to it from inside a lambda."""
    return F.transform(F.array(value), use)[0]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch; Spark bounds a batch by rows and by bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield from fn(batch)
    return df.mapInArrow(run, schema)


def add_columns(batch: pa.RecordBatch, **columns: pa.Array) -> pa.RecordBatch:
    """``batch`` and further columns behind its own."""
    return pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], [*batch.schema.names, *columns])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns named ``c0``, ``c1``, ... by position, so that no helper column meets one of the user's."""
    return docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])


def restored(rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` under their own names, from ``rows`` that hold them as ``numbered`` names them."""
    return rows.select(*[f"c{k}" for k in range(len(docs.columns))]).toDF(*docs.columns)


def place(docs: DataFrame, column: str) -> str:
    """The name of ``column`` of ``docs`` in ``numbered``."""
    return f"c{docs.columns.index(column)}"


def open_folder(uri: str):
    """File system and path of a folder in the shared store, for reading and writing inside tasks."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(uri)
