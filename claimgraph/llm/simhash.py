"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 10).

Two fingerprints that differ in at most ``2 r`` bits have a common variant: each
flips half of the differing bits.  So every distinct fingerprint stands for all its
variants within ``r`` bits, equal variants meet, and what meets is verified.

A fingerprint has 2,081 variants of up to two bits.  They are dealt into ``2**b``
buckets by a linear hash (the XOR of one column per set bit), so a flip changes the
bucket by the XOR of its columns, whatever the fingerprint.  A row sent to a bucket
is the fingerprint itself; the bucket's task lists the variants of it that fall
there and no others.  So each variant is compared in exactly one place, no bucket
depends on how similar the documents are, and one variant is shared by at most
2,081 distinct fingerprints.  Fingerprints that share a variant are all within
``2 r`` bits of each other, so a bucket links each to the smallest one instead of
listing pairs, and components stay exact.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.llm.common import add_columns, map_batches, numbered, place, restored
from claimgraph.session import cut_lineage

SHINGLE, SEED, RADIUS = 4, 42, 4
BITS = 64
FEWEST_BUCKET_BITS = 6
#: Variants that a bucket may hold on average: a few hundred MB and some ten seconds of one task.
BUCKET_VARIANTS = 1 << 25
SHINGLES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Signed 64-bit SimHash of the word shingles of a whole text; zero for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: lowers A-Z, splits at the six ASCII spaces
    if not words:
        return 0
    if len(words) < shingle:
        shingle = len(words)
    n, hash_of = len(words) - shingle + 1, xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES_AT_ONCE):
        part = words[at:at + SHINGLES_AT_ONCE + shingle - 1]
        rows = map(b" ".join, zip(*(part[k:] for k in range(shingle)), strict=False))
        hashes = np.array([hash_of(row, seed) for row in rows], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) of every row of ``docs``; a null text counts as empty."""
    def run(batch):
        fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return map_batches(rows, run, "doc_id bigint, fp bigint")


def bucket_bits(n: int, per_fingerprint: int) -> int:
    """Buckets grow with the number of fingerprints, so that a bucket does not."""
    wanted = int(np.ceil(np.log2(max(1, n * per_fingerprint / BUCKET_VARIANTS))))
    return min(max(FEWEST_BUCKET_BITS, wanted), 30)


def columns(bits: int) -> np.ndarray:
    """The linear hash: for six bits all 64 values, so that every bucket gets 33 variants (one gets 2); more bits are mixed in."""
    out = np.zeros(BITS, np.uint64)
    for k in range(BITS):
        mixed = (k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        mixed = (mixed ^ mixed >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
        out[k] = (k | (mixed >> 20) << 6) & (1 << bits) - 1
    return out


def flips(bits: int, radius: int) -> dict[int, np.ndarray]:
    """By change of bucket: the masks of up to ``radius`` bits that cause it."""
    cols = columns(bits).tolist()
    found: dict[int, list[int]] = {}
    for size in range(radius + 1):
        for chosen in combinations(range(BITS), size):
            change = mask = 0
            for k in chosen:
                change ^= cols[k]
                mask |= 1 << k
            found.setdefault(change, []).append(mask)
    return {change: np.array(masks, np.uint64) for change, masks in found.items()}


def bucket_of(fps: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(fps), np.int64)
    for k, column in enumerate(columns(bits).tolist()):
        out ^= np.where(fps >> np.uint64(k) & np.uint64(1), column, 0)
    return out


def scatter(fps: np.ndarray, bits: int, changes: np.ndarray):
    """(bucket, its fingerprints) for all buckets that hold a variant of some of ``fps``."""
    step = max(1, (1 << 20) // len(changes))
    for at in range(0, len(fps), step):
        part = fps[at:at + step]
        targets = (bucket_of(part, bits)[:, None] ^ changes[None, :]).ravel()
        order = np.argsort(targets, kind="stable")
        sent = np.repeat(part, len(changes))[order]
        buckets, starts = np.unique(targets[order], return_index=True)
        for bucket, block in zip(buckets.tolist(), np.split(sent, starts[1:]), strict=True):
            yield bucket, block


def meet(fps: np.ndarray, bucket: int, bits: int, masks: dict[int, np.ndarray]) -> np.ndarray:
    """(k, 2) links between fingerprints that share a variant in this bucket, each to the smallest that shares it."""
    fps = np.unique(fps)
    change = bucket_of(fps, bits) ^ bucket
    variants, owners = [], []
    for c in np.unique(change).tolist():
        if c in masks:
            own = np.flatnonzero(change == c)
            variants.append((fps[own, None] ^ masks[c][None, :]).ravel())
            owners.append(np.repeat(own, len(masks[c])))
    if not variants:
        return np.zeros((0, 2), np.uint64)
    keys, own = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(keys)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return np.zeros((0, 2), np.uint64)
    place = np.minimum(np.searchsorted(shared, keys), len(shared) - 1)
    hit = shared[place] == keys
    place, own = place[hit], own[hit]
    least = np.full(len(shared), len(fps))
    np.minimum.at(least, place, own)
    links = np.stack([fps[own], fps[least[place]]], axis=1)
    return np.unique(links[links[:, 0] != links[:, 1]], axis=0)


def linked(distinct: DataFrame, n: int, radius: int = RADIUS) -> DataFrame:
    """(a, b): verified links that connect all of ``n`` distinct fingerprints within ``radius`` bits."""
    if radius % 2:
        raise ValueError("the radius is halved and must be even")
    per = sum(1 for size in range(radius // 2 + 1) for _ in combinations(range(BITS), size))
    bits = bucket_bits(n, per)

    def send(batch):
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        changes = np.array(sorted(flips(bits, radius // 2)), np.int64)
        found = list(scatter(fps, bits, changes))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in found], pa.int64()),
                                          pa.array([f.astype("<u8").tobytes() for _, f in found], pa.binary())], ["bucket", "fps"])

    def join(block):
        bucket = block.column("bucket")[0].as_py()
        fps = np.concatenate([np.frombuffer(f.as_buffer(), "<u8") for f in block.column("fps")])
        links = meet(fps, bucket, bits, flips(bits, radius // 2)).view(np.int64)
        return pa.table({"a": links[:, 0], "b": links[:, 1]})

    sent = map_batches(distinct.select("fp"), send, "bucket bigint, fps binary")
    links = sent.groupBy("bucket").applyInArrow(join, "a bigint, b bigint").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def stars(links: DataFrame) -> DataFrame:
    """(node, root): every node that has a link, but for the roots, with the smallest node of its component.

    Alternates two steps until nothing changes: larger neighbours move to the smallest
    neighbour, then smaller ones do.  Minima are aggregated before they are joined back,
    so a node with a third of all links is never gathered.
    """
    def key(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()

    edges = cut_lineage(links.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root")).distinct())
    before = key(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("low"))
        moved = (both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("low").alias("root"))
                 .where("node <> root").distinct())
        low = moved.groupBy("node").agg(F.min("root").alias("low"))
        edges = cut_lineage(moved.join(low, "node").select(
            F.explode(F.array(F.struct(F.col("root").alias("node"), F.col("low").alias("root")),
                              F.struct(F.col("node"), F.col("low").alias("root")))).alias("e"))
            .select("e.*").where("node <> root").distinct())
        now = key(edges)
        if now == before:
            break
        before = now
    return edges


def components(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id): distinct fingerprints of ``marked`` (doc_id, fp), the smallest fingerprint and doc_id reachable from them."""
    distinct = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    roots = stars(linked(distinct, distinct.count(), radius))
    named = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return named.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id), one row per row of ``docs``.

    A null or empty text has fingerprint zero and is linked like any other; repeated rows
    repeat; a null doc_id has a component but names none, so a component of null ids only
    is null; an empty table gives an empty one.  Other columns are not read.
    """
    marked = cut_lineage(fingerprints(docs, shingle, seed))
    return marked.join(components(marked, radius), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` without near-copies: of each component the row with the smallest doc_id stays.

    Rows that tie (repeated ids, null ids last) are ordered by their text and one stays,
    also where all rows of a component lack an id.  A null or empty text is a copy of any
    other such text; other columns pass through unchanged, whatever their names; an empty
    table gives an empty one.
    """
    plain, doc_id, text = numbered(docs), place(docs, "doc_id"), place(docs, "text")
    at = plain.columns.index(text)

    def run(batch):
        yield add_columns(batch, fp=pa.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(at)], pa.int64()))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema)
    rows = map_batches(plain, run, f"{fields}, fp bigint")
    marked = cut_lineage(rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), "fp"))
    order = [F.col(doc_id).asc_nulls_last(), F.col(text).asc_nulls_last()]
    # The rank is cut to one row per fingerprint in every task before its rows move.
    own = rows.withColumn("rank", F.row_number().over(Window.partitionBy("fp").orderBy(*order))).where("rank = 1").drop("rank")
    groups = components(marked, radius).select("fp", "root")
    least = Window.partitionBy("root").orderBy(*order)
    return restored(own.join(groups, "fp").withColumn("rank", F.row_number().over(least)).where("rank = 1"), docs)
