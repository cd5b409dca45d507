"""Benchmark decontamination by a prefix-filtered containment join (operator 3).

The windows of the benchmark items are the sets to be contained.  Their words are
ordered by how often the whole corpus has them, rarest first.  Containment must be
whole, so the necessary prefix of a window is its one rarest word: a document that
lacks it cannot hold the window.  Document words join those prefixes only; the place of
the word inside its window bounds where the window would start and end (positional and
length bound), and what is left is verified word by word.

Built-in functions only.  Documents are read twice, once for the word counts and once
for the join, and never shuffled with their text: a window meets a document inside the
document's own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import ascii_lower, numbered, place, restored, words_of
from claimgraph.session import cut_lineage

WINDOW = 10
#: Everything outside ASCII letters, digits and characters beyond ASCII.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Windows are broadcast in blocks of about so many bytes of item text.
BLOCK_BYTES = 8 << 20


def words(text: Column) -> Column:
    return words_of(ascii_lower(text.cast("string")), BREAKS)


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, window): the distinct windows of every item as arrays of words."""
    rows = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w"))
    size = F.size("w")
    starts = F.sequence(F.lit(1), F.greatest(size - window + 1, F.lit(1)))
    return (rows.where(size > 0)
            .select("item", F.explode(F.array_distinct(F.transform(starts, lambda i: F.slice("w", i, window)))).alias("window")))


def word_counts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(word, n): how often all documents together have each word of ``vocabulary`` (few rows, already in blocks)."""
    return (docs.select(F.explode(words(F.col("text"))).alias("word"))
            .join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n")))


def prefixes(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """``windows`` (window_id, window) with their prefix word and its place; windows with a word no document has are gone."""
    parts = windows.select("window_id", F.posexplode("window").alias("place", "word"))
    counts = word_counts(docs, parts.select("word").distinct())
    ranked = (parts.join(counts, "word", "left")
              .groupBy("window_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "place")).alias("first")))
    return (windows.join(ranked, "window_id").where("first.n > 0")
            .select("window_id", "window", F.col("first.word").alias("prefix"), F.col("first.place").alias("place")))


def occurrences(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """One row per place of ``rows`` (row, w) where a window of ``keyed`` occurs, and one row (start 0) per document."""
    # The empty word in front stands for the document itself and moves its words to places from one.
    marked = rows.withColumn("w", F.concat(F.array(F.lit("")), F.col("w")))
    met = (marked.select("*", F.posexplode("w").alias("at", "word"))
           .join(F.broadcast(keyed), F.col("word") == F.col("prefix"), "left")
           .withColumn("start", F.col("at") - F.col("place")).withColumn("len", F.size("window"))
           .where((F.col("at") == 0) | (F.col("start") >= 1) & (F.col("start") + F.col("len") <= F.size("w"))
                  & (F.slice("w", F.greatest("start", F.lit(1)) + 1, F.col("len")) == F.col("window"))))
    return met.select("row", "doc_id", (F.size("w") - 1).alias("n_words"), F.coalesce("start", F.lit(0)).alias("start"),
                      F.coalesce("len", F.lit(0)).alias("len"), "window_id")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, n_words, n_hit, items): what each document shares with the items.

    ``n_hit`` counts the words inside any occurrence of a window, ``items`` are the sorted
    ids of the items with occurring windows.  Null and empty texts have no words and meet
    nothing; a null item id hits words but is not listed; repeated rows of ``docs`` give a
    row each (``row`` numbers them), repeated items count once; empty tables give an empty
    result or no hits.  Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", words(F.col("text")).alias("w"))
    total = items.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0
    n_blocks = int(total // block_bytes) + 1
    pairs = item_windows(items, window).withColumn("window_id", F.sha2(F.array_join("window", " "), 256))
    pairs = cut_lineage(pairs.withColumn("block", F.pmod(F.xxhash64("window_id"), F.lit(n_blocks))))
    found = None
    for block in range(n_blocks):
        own = pairs.where(F.col("block") == block).select("window_id", "window").distinct()
        keyed = cut_lineage(prefixes(own, docs))
        part = occurrences(rows, keyed)
        found = part if found is None else found.unionByName(part)
    found = cut_lineage(found)
    spans = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1))))
    hits = found.groupBy("row", "doc_id", "n_words").agg(
        F.collect_set(F.when(F.col("len") > 0, F.struct("start", "len"))).alias("spans"))
    # Every window of a document once, then its items; a window that many documents hold is not gathered.
    named = (found.where("len > 0").select("row", "window_id").distinct()
             .join(pairs.select("window_id", "item").distinct(), "window_id")
             .groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items")))
    return hits.join(named, "row", "left").select(
        "row", "doc_id", F.col("n_words").cast("bigint").alias("n_words"), F.size(spans).cast("bigint").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per document."""
    return contamination(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text shares no window with the items.

    A null or empty text stays, as does every row when there are no items; repeated rows
    go or stay together; other columns pass through unchanged, whatever their names.
    """
    key = F.sha2(F.col("text").cast("string"), 256)
    bad = contamination(docs.select(key.alias("doc_id"), "text"), items).where("n_hit > 0")
    rows = numbered(docs).withColumn("key", F.sha2(F.col(place(docs, "text")).cast("string"), 256))
    return restored(rows.join(bad.select(F.col("doc_id").alias("key")).distinct(), "key", "left_anti"), docs)


REPORT_SQL = """
with d as (
    select row_number() over () as rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
    from documents),
b as (
    select cast(item_id as varchar) as item, list_filter(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
    from benchmark),
bw as (
    select distinct item, array_to_string(w[i:i + 9], ' ') as win, least(len(w), 10) as n
    from (select item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct n from bw),
dw as (
    select rid, i, n, array_to_string(w[i:i + n - 1], ' ') as win
    from (select rid, w, n, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
occ as (select dw.rid, dw.i, dw.n, bw.item from dw join bw using (win, n)),
hit as (
    select rid, count(distinct p) as n_hit
    from (select rid, unnest(range(i, i + n)) as p from (select distinct rid, i, n from occ)) group by rid),
its as (select rid, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from occ group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (rid) left join its using (rid)
"""
