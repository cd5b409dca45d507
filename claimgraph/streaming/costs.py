"""The cost ledger as it arrives: spend per stage and hour, and an alert at the ceiling."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from claimgraph import schemas as S
from claimgraph.operators.ledger import running_total, with_cost
from claimgraph.streaming import tables

EXACT = T.DecimalType(38, 10)
TOTALS = S.struct(cost=EXACT)
ALERTS = S.struct(record_id=T.LongType(), ts=T.TimestampType(), running_total=T.DoubleType())
SUMS = S.struct(window_start=T.TimestampType(), window_end=T.TimestampType(), stage=T.StringType(), calls=T.LongType(), cost=EXACT)
LATE = S.struct(record_id=T.LongType(), ts=T.TimestampType(), model=T.StringType(), stage=T.StringType(), window_start=T.TimestampType(),
                cost=EXACT)
MARKS = S.struct(newest=T.TimestampType(), watermark=T.TimestampType())


def _exact() -> Column:
    return F.round(F.col("cost"), 10).cast("decimal(30,10)")


def track_spend(calls: DataFrame, price_table: DataFrame, target: str, checkpoint: str, window: str = "1 hour",
                lateness: str = "10 minutes") -> StreamingQuery:
    """Spend per stage and window as it arrives; calls whose window has closed go to ``late``, whole.

    The watermark of a batch is the newest time of all batches before it less ``lateness``, and a window that
    ends at or before it is closed.  A batch stores its partial sums (``sums``), its late calls (``late``) and
    one row with the newest time so far (``marks``), so a batch reads one row of the batch before it however
    long the stream has run, and a repeated batch counts once.  A call without a time belongs to no
    window and is late.
    """
    spark = calls.sparkSession
    for name, schema in (("sums", SUMS), ("late", LATE), ("marks", MARKS)):
        tables.prepare(spark, f"{target}/{name}", schema)

    def store(batch: DataFrame, batch_id: int) -> None:
        last = tables.read_batch(spark, f"{target}/marks", MARKS, batch_id - 1).first()
        newest = F.lit(last.newest if last else None).cast("timestamp")
        watermark = newest - F.expr(f"interval {lateness}")
        priced = with_cost(batch, price_table).select(
            "record_id", "ts", "model", "stage", F.window("ts", window).alias("w"), _exact().alias("cost")).union(
            # A null time has no window and would be dropped with it.
            with_cost(batch.where("ts is null"), price_table).select(
                "record_id", "ts", "model", "stage", F.lit(None).cast("struct<start:timestamp,end:timestamp>"), _exact()))
        placed = priced.select("record_id", "ts", "model", "stage", F.col("w.start").alias("window_start"),
                               F.col("w.end").alias("window_end"), "cost")
        late = F.col("window_end").isNull() | F.coalesce(F.col("window_end") <= watermark, F.lit(False))
        tables.write_batch(placed.where(late).select(*[F.col(f.name).cast(f.dataType) for f in LATE]), f"{target}/late", batch_id)
        sums = placed.where(~late).groupBy("window_start", "window_end", "stage").agg(
            F.count("*").alias("calls"), F.sum("cost").cast(EXACT).alias("cost"))
        tables.write_batch(sums, f"{target}/sums", batch_id)
        tables.write_batch(batch.agg(F.greatest(F.max("ts"), newest).alias("newest")).select("newest", watermark.alias("watermark")),
                           f"{target}/marks", batch_id)

    return (calls.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def spend(spark: SparkSession, target: str, flush: bool = False) -> DataFrame:
    """(window_start, stage, calls, cost) of the windows that are closed by now; with ``flush``, once the input has ended, of all."""
    sums = tables.read(spark, f"{target}/sums", SUMS)
    if not flush:
        newest = tables.read(spark, f"{target}/marks", MARKS).agg(F.max("watermark")).scalar()
        sums = sums.where(F.col("window_end") <= newest)
    return sums.groupBy("window_start", "stage").agg(F.sum("calls").alias("calls"), F.sum("cost").cast(EXACT).alias("cost"))


def late_calls(spark: SparkSession, target: str) -> DataFrame:
    """The calls that arrived after their window had closed, each with its batch."""
    return tables.read(spark, f"{target}/late", LATE)


def watch_ceiling(calls: DataFrame, price_table: DataFrame, ceiling: float, target: str, checkpoint: str) -> StreamingQuery:
    """One total over all batches; the record that first reaches the ceiling is written to ``alerts``.

    Each batch stores the total up to its end, so the total before a batch is one row of the batch before
    it, and a repeated batch counts once.
    """
    spark = calls.sparkSession
    tables.prepare(spark, f"{target}/totals", TOTALS)
    tables.prepare(spark, f"{target}/alerts", ALERTS)

    def store(batch: DataFrame, batch_id: int) -> None:
        priced = with_cost(batch, price_table)
        last = tables.read_batch(spark, f"{target}/totals", TOTALS, batch_id - 1).first()
        before = last.cost if last else Decimal(0)
        tables.write_batch(priced.agg((F.coalesce(F.sum(_exact()), F.lit(0)) + F.lit(before)).cast(EXACT).alias("cost")),
                           f"{target}/totals", batch_id)
        # Totals stay decimal until they have been compared.
        total = F.round("running_total", 10).cast("decimal(30,10)") + F.lit(before).cast("decimal(30,10)")
        limit = F.lit(str(ceiling)).cast("decimal(30,10)")
        totals = running_total(priced).withColumn("_total", total).withColumn("running_total", total.cast("double"))
        crossed = totals.where(F.lit(before).cast("decimal(30,10)") < limit).where(F.col("_total") >= limit)
        first = crossed.orderBy("ts", "record_id").limit(1)
        tables.write_batch(first.select(*ALERTS.fieldNames()), f"{target}/alerts", batch_id)

    return (calls.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
