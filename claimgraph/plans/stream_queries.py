"""Structured Streaming jobs, run to the end of their input."""

from pyspark.sql import functions as F

from claimgraph.operators import ledger as L
from claimgraph.plans.registry import query, share
from claimgraph.plans.source_queries import articles, assertion_responses
from claimgraph.sources import files
from claimgraph.sources.derived import MODELS
from claimgraph.streaming import costs as K
from claimgraph.streaming import ingest as I
from claimgraph.streaming import tables


def _run(start, times=1):
    for _ in range(times):
        start().awaitTermination()


@query("st1_article_ingest", """select replace(title, ' ', '_') as document_id, sequence, section_title, content, token_estimate
    from v_article_chunks join (select document_id, title from v_text) using (document_id)""")
def article_ingest(c):
    source, target, checkpoint = (files.scratch_folder(c.spark) for _ in range(3))
    files.write_json(articles(c), source)
    stream = lambda: I.ingest_articles(I.article_stream(c.spark, source, one_per_line=True), target, checkpoint)
    _run(stream)
    # The same articles again in new files add nothing.
    articles(c).write.mode("append").json(source)
    _run(stream)
    return (tables.read(c.spark, f"{target}/chunks", I.CHUNKS)
            .select("document_id", "sequence", "section_title", "content", "token_estimate"))


@query("st1_response_ingest", """select cast(chunk_id as string) as chunk_id, count(*) as assertions from v_assertions
    where chunk_id in (select chunk_id from v_ok_chunks) and assertion_id % 11 > 1 group by 1""")
def response_ingest(c):
    source, target, checkpoint = (files.scratch_folder(c.spark) for _ in range(3))
    rows = assertion_responses(c).select(F.col("chunk_id").cast("string"), F.col("document_id").cast("string"), "doc_title", "raw")
    files.write_json(rows, source)
    _run(lambda: I.ingest_responses(I.response_stream(c.spark, source), target, checkpoint), times=2)
    return (c.spark.read.parquet(f"{target}/assertions").groupBy("chunk_id").agg(F.count("*").alias("assertions")))


def cost_stream(c):
    """The cost log read as a stream of files."""
    schema = c.table("events").schema
    return _calls(c.spark.readStream.schema(schema).parquet(f"{c.sf_dir}/events*.parquet"))


def cost_log(c):
    """The same log as a table."""
    return _calls(c.table("events"))


def _calls(events):
    model = F.get(F.array(*[F.lit(m) for m in MODELS]), (F.col("user_id") % len(MODELS)).cast("int"))
    return events.select(F.col("event_id").alias("record_id"), F.col("ts").cast("timestamp").alias("ts"), model.alias("model"), F.col("event_type").alias("stage"),
                         F.floor(F.col("value") * 100).alias("input_tokens"), F.floor(F.col("value") * 20).alias("output_tokens"))


@query("st2_spend_per_stage", """select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') as window_start, stage, count(*) as calls,
        cast(sum(cast(round(cost, 10) as decimal(28, 10))) as double) as cost
    from v_priced group by 1, 2""")
def spend_per_stage(c):
    target, checkpoint = files.scratch_folder(c.spark), files.scratch_folder(c.spark)
    _run(lambda: K.track_spend(cost_stream(c), L.prices(c.spark), target, checkpoint))
    return (K.spend(c.spark, target, flush=True)
            .select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "stage", "calls", F.col("cost").cast("double").alias("cost")))


def two_deliveries(c):
    """Spend of the cost log when every tenth call arrives only after all others; the folder that holds it."""
    source, target, checkpoint = (files.scratch_folder(c.spark) for _ in range(3))
    calls = cost_log(c)
    for part in ("record_id % 10 <> 3", "record_id % 10 = 3"):
        calls.where(part).write.mode("append").parquet(source)
        stream = c.spark.readStream.schema(calls.schema).parquet(source)
        _run(lambda stream=stream: K.track_spend(stream, L.prices(c.spark), target, checkpoint))
    return target


share("v_arrivals", """select *, date_trunc('hour', ts) as window_start, record_id % 10 = 3 and date_trunc('hour', ts) + interval 1 hour
        <= (select max(ts) from v_priced where record_id % 10 <> 3) - interval 10 minute as late from v_priced""")


@query("st2_late_calls", """select record_id, stage, strftime(window_start, '%Y-%m-%d %H:%M') as window_start, cast(cast(round(cost, 10) as decimal(28, 10)) as double) as cost
    from v_arrivals where late""")
def late_calls(c):
    return K.late_calls(c.spark, two_deliveries(c)).select(
        "record_id", "stage", F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), F.col("cost").cast("double").alias("cost"))


@query("st2_spend_beside_late_calls", """select strftime(window_start, '%Y-%m-%d %H:%M') as window_start, stage, count(*) as calls,
        cast(sum(cast(round(cost, 10) as decimal(28, 10))) as double) as cost from v_arrivals where not late group by 1, 2""")
def spend_beside_late_calls(c):
    return (K.spend(c.spark, two_deliveries(c), flush=True)
            .select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "stage", "calls", F.col("cost").cast("double").alias("cost")))


@query("st2_ceiling_alert", """select record_id, running_total from v_totals
    where running_total >= 1.0 order by ts, record_id limit 1""")
def ceiling_alert(c):
    target, checkpoint = files.scratch_folder(c.spark), files.scratch_folder(c.spark)
    _run(lambda: K.watch_ceiling(cost_stream(c), L.prices(c.spark), 1.0, target, checkpoint))
    return tables.read(c.spark, f"{target}/alerts", K.ALERTS).select("record_id", "running_total")
