"""Sharding by rendezvous hashing of record keys over weighted shards (operator 13).

Every shard draws an exponential waiting time for a key from a hash of (key, shard), divided
by the shard's weight, and the shortest wait takes the record.  The draw of a shard does not
depend on the others.  So a shard gets its share of the weights, a further shard takes records
only into itself, and a shard that goes only gives away its own.

The assignment is an expression of the row: nothing is shuffled and no key is gathered.  The
places within a shard follow a digest of the record, so a shard's order is mixed and does not
depend on the layout of the input.  Equal records collapse in the map tasks before they are
numbered, and a digest's first digits cut every shard into blocks of a bounded share.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.ranking import running
from claimgraph.session import cut_lineage

#: Digits of a hash that a draw uses: 52 bits, which a double holds with the half step that keeps a draw inside (0, 1).
DRAW_DIGITS = 13
#: Digits of a digest that name a block of a shard: 4,096 blocks.
BLOCK_DIGITS = 3
#: Equal records that one row unfolds into at once.
COPIES_AT_ONCE = 1000


def record_key(*columns: Column) -> Column:
    """A text that is the same for equal values; a null has a text of its own."""
    return F.concat_ws("/", *[F.coalesce(c.cast("string"), F.lit("null")) for c in columns])


def draw(key: Column, shard: int) -> Column:
    """A number inside (0, 1) that depends on key and shard alone."""
    digits = F.substring(F.md5(F.concat(key, F.lit(f"/{shard}"))), 1, DRAW_DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(16 ** DRAW_DIGITS))


def owner(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the shortest wait; equal waits go to the smaller shard.  A shard of weight zero gets nothing."""
    if not any(w > 0 for w in weights) or any(w < 0 for w in weights):
        raise ValueError("weights are zero or more and one is above zero")
    waits = [F.struct((-F.ln(draw(key, s)) / F.lit(float(w))).alias("wait"), F.lit(s).alias("shard"))
             for s, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*waits))["shard"]


def assign(docs: DataFrame, key: Column, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """(row, shard, grown_shard): every row of ``docs`` with its shard under ``weights`` and under ``grown`` (null without).

    ``row`` is a struct of all columns of ``docs``, so no name of theirs can clash.  Repeated keys
    share a shard, a null key is a key like any other, and an empty table gives an empty one.
    """
    later = F.lit(None).cast("int") if grown is None else owner(key, grown)
    return docs.select(F.struct("*").alias("row"), owner(key, weights).alias("shard"), later.alias("grown_shard"))


def write_shards(docs: DataFrame, key: Column, weights: Sequence[float], folder: str) -> None:
    """Whole rows as Parquet, one folder ``shard=k`` a shard.

    Every task writes its own file a shard, so a shard that holds a hot key is written by all tasks.
    """
    assign(docs, key, weights).select("row", "shard").write.partitionBy("shard").parquet(folder)


def read_shard(spark: SparkSession, folder: str, shard: int) -> DataFrame:
    """The rows of one shard with the columns they had."""
    return spark.read.parquet(folder).where(F.col("shard") == shard).select("row.*")


def numbered(records: DataFrame, within: str, start: str) -> DataFrame:
    """Every row of ``records`` with its place from 0 within its value of ``within``, in the order of a digest of the row.

    Equal rows are counted first and unfolded last, in steps of a bounded number that are dealt to
    other tasks: a record with a third of all rows is one row while places are summed.
    """
    row = F.struct(*[F.col(f"`{n}`") for n in records.columns])
    mark = F.md5(record_key(*[F.col("row").getField(n) for n in records.columns]))
    counted = records.groupBy(row.alias("row")).agg(F.count("*").alias("copies")).select(
        "row", "copies", mark.alias("mark"), F.col("row").getField(within).alias("within"))
    placed = running(cut_lineage(counted), ["within"], [F.col("mark"), F.col("row")], F.substring("mark", 1, BLOCK_DIGITS),
                     {"end": F.col("copies")})
    first = F.col("end") - F.col("copies")
    steps = placed.select("row", "mark", "end", F.explode(F.sequence(first, F.col("end") - 1, F.lit(COPIES_AT_ONCE))).alias("from"))
    last = F.least(F.col("from") + COPIES_AT_ONCE, F.col("end")) - 1
    return (steps.repartition("mark", "from")
            .select("row", F.explode(F.sequence("from", last)).alias("place")).select("row.*", F.col("place").alias(start)))


def layout(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), one row per row of ``docs``.

    The key is ``doc_id``; rows with a repeated id share a shard, and so do rows with a null id.
    ``size`` is the bytes of the text in UTF-8 plus one, ``text_crc32`` its checksum; a null text
    counts as empty.  ``slot`` runs from 0 without a gap within a shard; equal records take
    neighbouring slots.  Other columns are not read; an empty table gives an empty one.
    """
    placed = assign(docs.select("doc_id", "text"), record_key(F.col("doc_id")), weights, grown)
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    records = placed.select(
        F.col("row.doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "grown_shard")
    return numbered(records, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def layout_sql(shards: int) -> str:
    """Checking SQL of ``layout`` for ``shards`` equal weights and one shard more.

    CRC-32 is not among that database's functions; it is one step per byte over the polynomial's table.
    """
    return f"""
with recursive steps(v, c, k) as (
    select range::bigint, range::bigint, 0 from range(256)
    union all
    select v, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8),
crc as (select list(c order by v) as t from steps where k = 8),
waits as (
    select doc_id, coalesce(text, '') as text,
           list_transform(range({shards} + 1), lambda s: -ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/' || s), 1, 13))::bigint
                                                         + 0.5) / 4503599627370496.0)) as w
    from documents),
bytes as (
    select doc_id, w, text, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::bigint) as b from waits),
rows_ as (
    select doc_id, (octet_length(encode(text)) + 1)::bigint as size,
           xor(list_reduce(list_prepend(4294967295::bigint, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) as text_crc32,
           (list_position(w, list_min(w[1:{shards}])) - 1)::int as shard, (list_position(w, list_min(w)) - 1)::int as grown_shard
    from bytes, crc)
select doc_id, size, text_crc32, 'key' as law, shard,
       (row_number() over (partition by shard order by
            md5(coalesce(doc_id::varchar, 'null') || '/' || size || '/' || text_crc32 || '/' || shard || '/' || grown_shard),
            doc_id, size, text_crc32) - 1)::bigint as slot, grown_shard
from rows_
"""
