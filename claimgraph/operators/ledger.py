"""Cost ledger: prices, running totals and the ceiling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.ranking import running

# Price per million tokens of input and output; the embedding model per thousand input tokens.
PRICES = [("gemini-1.5-flash", 0.075, 0.30, 1_000_000), ("gemini-1.5-pro", 1.25, 5.00, 1_000_000),
          ("text-embedding-004", 0.000025, 0.0, 1_000)]


def prices(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(rows or PRICES, "model string, input_price double, output_price double, unit int")


def with_cost(calls: DataFrame, price_table: DataFrame) -> DataFrame:
    """Cost per call; a model without a price costs 0 and is marked.

    The price table is a list of models; it is broadcast by the planner's own size check.
    """
    joined = calls.join(price_table, "model", "left")
    cost = F.col("input_tokens") / F.col("unit") * F.col("input_price") + F.col("output_tokens") / F.col("unit") * F.col("output_price")
    return (joined.withColumn("cost", F.coalesce(cost, F.lit(0.0))).withColumn("is_priced", F.col("unit").isNotNull())
            .drop("input_price", "output_price", "unit"))


def unpriced_models(priced: DataFrame) -> DataFrame:
    return priced.where("not is_priced").groupBy("model").agg(F.count("*").alias("calls"))


def day(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def ledger_piece(priced: DataFrame, pieces: int = 128) -> Column:
    """A piece of the ledger in the order (ts, record_id) with a bounded share of its rows.

    Cuts of the times come from a mergeable sketch.  Times between two cuts make a piece and times equal to a
    cut another; a time that many calls share is a cut, and its piece is cut again by record id.
    """
    share = [k / pieces for k in range(1, pieces)]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    cuts = F.array_sort(F.array_distinct(F.percentile_approx(at, share, 20 * pieces)))
    cut = priced.where("ts is not null").agg(F.coalesce(cuts, F.array().cast("array<bigint>")).alias("cuts"),
                                             F.coalesce(F.percentile_approx("record_id", share, 20 * pieces),
                                                        F.array().cast("array<bigint>")).alias("ids")).first()
    # Two lists of at most ``pieces`` numbers, whatever the size of the ledger.
    # One text is one constant of the plan, where a list would be one for each number.
    times, ids = (F.split(F.lit(",".join(map(str, sorted(set(values)))) or None), ",").cast("array<bigint>") for values in (cut.cuts, cut.ids))
    place = F.coalesce(2 * F.size(F.filter(times, lambda v: v < at)) + F.when(F.array_contains(times, at), 1).otherwise(0), F.lit(-1))
    within = F.when(place % 2 == 0, 0).otherwise(F.size(F.filter(ids, lambda v: v < F.coalesce("record_id", F.lit(0)))))
    return F.struct(place.alias("place"), within.alias("within"))


def running_total(priced: DataFrame, digits: int = 10) -> DataFrame:
    """The running total over the whole ledger, in two levels: within a piece, then over pieces of even size.

    Costs are added as decimals, so the total does not depend on how tasks split the rows.
    """
    exact = F.round(F.col("cost"), digits).cast(f"decimal(30,{digits})")
    out = running(priced.withColumn("ledger", F.lit("all")), ["ledger"], [F.col("ts"), F.col("record_id")],
                  ledger_piece(priced), {"running_total": exact})
    return out.drop("ledger").withColumn("running_total", F.col("running_total").cast("double"))


def ceiling_crossing(totals: DataFrame, ceiling: float) -> DataFrame:
    """The first record at or above the ceiling."""
    first = F.min_by(F.struct("record_id", "ts", "running_total"), F.struct("ts", "record_id"))
    return totals.where(F.col("running_total") >= ceiling).agg(first.alias("r")).where("r is not null").select("r.*")


def cost_by_stage(priced: DataFrame, digits: int = 10) -> DataFrame:
    """Calls, tokens and cost per stage and model, with subtotals per stage and overall."""
    exact = F.round(F.col("cost"), digits).cast(f"decimal(30,{digits})")
    return (priced.rollup("stage", "model").agg(
        F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(exact).cast("double").alias("cost"))
        .select(F.coalesce("stage", F.lit("all")).alias("stage"), F.coalesce("model", F.lit("all")).alias("model"),
                "calls", "input_tokens", "output_tokens", "cost"))


def resume_total(totals: DataFrame) -> DataFrame:
    return totals.agg(F.coalesce(F.max("running_total"), F.lit(0.0)).alias("resume_total"))
