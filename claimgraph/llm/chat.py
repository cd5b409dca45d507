"""Chat formatting by multi-party perspective rotation (operator 2).

For every participant of a conversation the whole dialogue is rendered once with that
speaker as the assistant and everyone else as a named user; the mask covers what that
speaker says.  A rendered dialogue is a run of segments, one per message, and stays in
rows: a conversation may hold a third of all messages, so no task gathers one.  Its text
is its segments in order, and all places are character places in that text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SYSTEM = "system"
OPEN, CLOSE, LINE = "<|im_start|>", "<|im_end|>", "\n"
#: Messages of a conversation are numbered inside blocks of so many turns, and blocks along the conversation.
BLOCK_TURNS = 256


def header(role: Column, speaker: Column) -> Column:
    return F.concat(F.lit(OPEN), F.when(role == speaker, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM))
                    .otherwise(F.concat(F.lit("user name="), role)), F.lit(LINE))


def perspectives(messages: DataFrame) -> DataFrame:
    """(conv_id, speaker, segment, turn, role, content, rendered, start, mask_start, mask_end).

    One row per conversation, participant and message.  Participants are the distinct roles
    but ``system``; a null role is the participant ``unknown``.  Messages are ordered by
    turn (nulls first), role and text; repeated rows are segments of their own.  A null
    text is empty.  ``mask_start`` and ``mask_end`` bound what the speaker says including
    the closing mark, and are null on segments of others.  Conversations without a
    participant give no row; a null conv_id is a conversation of its own; an empty table
    gives an empty one; other columns are not read.
    """
    rows = messages.select(
        F.struct(F.col("conv_id")).alias("key"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("content"))
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(1 << 62))))
    speakers = rows.where(F.col("role") != SYSTEM).select("key", F.col("role").alias("speaker")).distinct()
    # Everyone speaks in every block of the conversation: few rows, and a long conversation is spread over its blocks.
    cast = rows.select("key", "block").distinct().join(speakers, "key")
    marked = (rows.join(cast, ["key", "block"])
              .withColumn("head", header(F.col("role"), F.col("speaker")))
              .withColumn("rendered", F.concat("head", "content", F.lit(CLOSE + LINE)))
              .withColumn("chars", F.length("rendered").cast("bigint")))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("content")]
    inside = Window.partitionBy("key", "block", "speaker").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = marked.groupBy("key", "block", "speaker").agg(F.count("*").alias("n"), F.sum("chars").alias("c"))
    earlier = Window.partitionBy("key", "speaker").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("key", "block", "speaker", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"),
                           F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c_before"))
    placed = (marked.withColumn("n_here", F.count("*").over(inside)).withColumn("c_here", F.sum("chars").over(inside))
              .join(before, ["key", "block", "speaker"])
              .withColumn("start", F.col("c_before") + F.col("c_here") - F.col("chars")))
    own = F.col("role") == F.col("speaker")
    return placed.select(
        F.col("key.conv_id").alias("conv_id"), "speaker", (F.col("n_before") + F.col("n_here")).alias("segment"), "turn", "role", "content",
        "rendered", "start", F.when(own, F.col("start") + F.length("head")).alias("mask_start"),
        F.when(own, F.col("start") + F.col("chars") - len(LINE)).alias("mask_end"))


PERSPECTIVES_SQL = """
with m as (
    select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as content from conversations),
s as (select distinct conv_id, role as speaker from m where role <> 'system'),
r as (
    select m.conv_id, speaker, turn, role, content,
           '<|im_start|>' || case when role = speaker then 'assistant' when role = 'system' then 'system'
                                  else 'user name=' || role end || chr(10) as head
    from m join s on m.conv_id is not distinct from s.conv_id),
t as (select *, head || content || '<|im_end|>' || chr(10) as rendered from r),
o as (
    select *, row_number() over w as segment,
           sum(length(rendered)) over (w rows between unbounded preceding and current row) - length(rendered) as start
    from t window w as (partition by conv_id, speaker order by turn nulls first, role, content))
select conv_id, speaker, cast(segment as bigint) as segment, turn, role, content, rendered, cast(start as bigint) as start,
       cast(case when role = speaker then start + length(head) end as bigint) as mask_start,
       cast(case when role = speaker then start + length(rendered) - 1 end as bigint) as mask_end
from o
"""
