"""Tables written one folder per micro-batch.

A batch that is run again after a failure overwrites its own folder, so its rows
appear once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def prepare(spark: SparkSession, path: str, schema: T.StructType) -> None:
    """Make an empty table where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    with_batch = T.StructType(schema.fields + [T.StructField("batch", T.LongType())])
    return spark.read.schema(with_batch).parquet(path)


def read_before(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of earlier batches; the folder name prunes the scan."""
    return read(spark, path, schema).where(F.col("batch") < batch_id)


def read_batch(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """Rows of one batch; only its folder is listed.  Batches before the first have no rows."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/batch={batch_id}")
