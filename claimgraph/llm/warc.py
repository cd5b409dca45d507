"""WARC archives: writer with revisit records and a salvage reader (operator 9).

A record is one gzip member, so a reader can start at any of them.  The reader checks
every record (member checksum, version line, declared length, closing line ends, block
digest).  After a failed check it looks for the next valid member or version line, goes
on there and reports the bytes between as a quarantined gap.  A member that holds more than
one record is searched in the same way, and what a broken member still gives is too: there
only records whose block digest agrees count, and the member itself stays a gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import open_folder
from claimgraph.sources.files import scratch_folder

ROLL_BYTES = 64 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16
VERSION = re.compile(rb"WARC/1\.[0-9]\r\n")
START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[0-9]\r\n")


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = DATE) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP header of its payload and leaves the payload out."""
    revisit = refers_to is not None
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
             + (b"" if revisit else payload))
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class Damaged(ValueError):
    """A failed check; ``end`` is where the bytes that it covers end, if they are known, ``content`` what a broken member gave."""

    def __init__(self, reason: str, end: int | None = None, content: bytes = b""):
        super().__init__(reason)
        self.end, self.content = end, content


@dataclass
class Found:
    """A record with its place, or (``problem`` set) a quarantined gap.

    ``inner`` is the place in the content of a member that holds more than one record or is
    broken.  Finds of one member share its offset and the last one of a sound member carries its length.
    """

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    problem: str | None = None
    inner: int | None = None


def parse(raw: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at ``at``."""
    if not re.match(rb"WARC/1\.[0-9]\r\n", raw[at:at + 10]):
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("headers do not end")
    headers = {}
    for line in raw[at:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        headers[key.strip().decode("utf-8", "replace").lower()] = value.strip().decode("utf-8", "replace")
    size = headers.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise Damaged("no length")
    start, end = stop + 4, stop + 4 + int(size)
    if raw[end:end + 4] != b"\r\n\r\n":
        raise Damaged("length does not fit")
    block = raw[start:end]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha1" and digest != base32_sha1(block):
        raise Damaged("block digest differs", end + 4)
    return headers, block, end + 4


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``at``."""
    unpacker, out, place = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof:
            if place >= len(data):
                raise Damaged("member does not end", content=b"".join(out))
            piece = data[place:place + STEP]
            out.append(unpacker.decompress(piece))
            place += len(piece)
    except zlib.error as err:
        raise Damaged(f"bad member: {err}", content=readable(data, at, place)) from None
    return b"".join(out), place - len(unpacker.unused_data)


def readable(data: bytes, at: int, place: int) -> bytes:
    """What the broken member at ``at`` gives before its error, which lies in the step at ``place``."""
    unpacker = zlib.decompressobj(31)
    out = [unpacker.decompress(data[at:place])]
    try:
        for k in range(place, min(place + STEP, len(data))):
            out.append(unpacker.decompress(data[k:k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def read_at(data: bytes, at: int, nested: bool = False) -> list[Found]:
    """The record at ``at``, or all finds of a member that holds more."""
    if nested or data[at:at + 2] != b"\x1f\x8b":
        headers, block, end = parse(data, at)
        return [Found(at, end - at, headers, block)]
    raw, end = inflate(data, at)
    found = list(salvage(raw, nested=True))
    if all(f.problem for f in found):
        raise Damaged(found[0].problem if found else "no version line", end)
    if len(found) == 1:
        return [Found(at, end - at, found[0].headers, found[0].block)]
    return [Found(at, end - at if f is found[-1] else 0, f.headers, f.block, f.problem, f.offset) for f in found]


def identity(found: Found) -> tuple:
    return found.headers.get("warc-record-id"), found.headers.get("warc-block-digest"), found.block


def salvage(data: bytes, nested: bool = False) -> Iterator[Found]:
    """Every valid record of an archive in order, and the gaps between them that no valid record covers.

    ``nested`` is for the content of a member, where only version lines begin records.
    """
    at, gap, reason, rescued = 0, None, "", set()
    while at < len(data):
        try:
            found = read_at(data, at, nested)
            # Bytes of a broken member may hold its records as they are.
            if rescued and identity(found[0]) in rescued:
                raise Damaged(reason, at + found[0].length)
        except Damaged as err:
            sound = [f for f in salvage(err.content, nested=True) if f.headers.get("warc-block-digest", "").startswith("sha1:")]
            fresh = [f for f in sound if identity(f) not in rescued]
            if gap is None or fresh:
                if gap is not None and gap < at:
                    yield Found(gap, at - gap, {}, b"", reason)
                gap, reason = at, str(err)
            for f in fresh:
                rescued.add(identity(f))
                yield Found(at, 0, f.headers, f.block, None, f.offset)
            following = (VERSION if nested else START).search(data, err.end or at + 1)
            # The bytes of a damaged member may hide the start of the next one when its own end was lost.
            at = following.start() if following else len(data)
            continue
        if gap is not None:
            yield Found(gap, at - gap, {}, b"", reason)
            gap, rescued = None, set()
        yield from found
        at += sum(f.length for f in found)
    if gap is not None:
        yield Found(gap, len(data) - gap, {}, b"", reason)


def roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): the page each record revisits, null for responses.

    First pages are minima per digest, aggregated before the shuffle; the join back splits
    a digest that many pages have.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    firsts = (rows.where(F.length("payload") >= least_bytes).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"))
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", "payload", F.when(F.col("page_id").eqNullSafe(F.col("first")), None).otherwise(F.col("first")).alias("refers_to"))


def write(pages: DataFrame, folder: str, least_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write the pages to archives of about ``roll_bytes`` under ``folder``; the manifest (file, n_records, n_bytes).

    Every attempt of a task names its files anew, and the manifest, a Parquet table, lists
    those of the attempts that Spark committed.
    """
    def run(batches):
        fs, path = open_folder(folder)
        fs.create_dir(path)
        out, file, n, size = None, "", 0, 0
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(k) for k in range(4)), strict=True):
                if out is None:
                    file, n, size = f"{path}/pages-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(file, compression=None)
                body = payload.as_py()
                data = member(record(page_id.as_py(), url.as_py(), body, base32_sha1(body), refers_to.as_py()))
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= roll_bytes:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist([{"file": file, "n_records": n, "n_bytes": size}])
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"file": file, "n_records": n, "n_bytes": size}])

    roles(pages, least_bytes).mapInArrow(run, "file string, n_records bigint, n_bytes bigint").write.parquet(f"{folder}/manifest")
    return pages.sparkSession.read.parquet(f"{folder}/manifest")


def read(manifest: DataFrame, with_block: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives in ``manifest`` (file).

    Columns: file, offset, length, inner, problem (null for a record), page_id, record_type,
    refers_to, uri, payload_bytes, payload_digest and, if asked for, block.  Archives are
    read one at a time and about ``STEP * 64`` bytes of records are handed on at once.
    """
    def number(text: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", text or "")
        return int(found[1]) if found else None

    def row(file: str, found: Found) -> dict:
        h = found.headers
        size = re.search(rb"\r\ncontent-length:\s*([0-9]+)", found.block.partition(b"\r\n\r\n")[0], re.I)
        return {"file": file, "offset": found.offset, "length": found.length, "inner": found.inner, "problem": found.problem,
                "page_id": number(h.get("warc-record-id")), "record_type": h.get("warc-type"), "refers_to": number(h.get("warc-refers-to")),
                "uri": h.get("warc-target-uri"), "payload_bytes": int(size[1]) if size else None,
                "payload_digest": h["warc-payload-digest"].partition(":")[2] if "warc-payload-digest" in h else None,
                **({"block": found.block} if with_block else {})}

    def run(batches):
        for batch in batches:
            for file in batch.column(0).to_pylist():
                fs, path = open_folder(file)
                with fs.open_input_stream(path, compression=None) as source:
                    data = source.read()
                rows, held = [], 0
                for found in salvage(data):
                    rows.append(row(file, found))
                    held += 256 + len(found.block) * with_block
                    if held >= STEP * 64:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    kinds = {"file": "string", "offset": "bigint", "length": "bigint", "inner": "bigint", "problem": "string", "page_id": "bigint", "record_type": "string",
             "refers_to": "bigint", "uri": "string", "payload_bytes": "bigint", "payload_digest": "string",
             **({"block": "binary"} if with_block else {})}
    arrow = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(k, arrow[v]) for k, v in kinds.items()])
    n = max(1, manifest.count())
    return (manifest.select("file").repartition(n, "file")
            .mapInArrow(run, ", ".join(f"{k} {v}" for k, v in kinds.items())))


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of pages written to archives and read back.

    A null html is an empty payload, a null url has no header; of equal payloads the
    smallest page id is the response, and repeated rows of it are responses too; a null
    page id revisits the smallest, and is a response where its payload has null ids only.
    An empty table gives an empty one; other columns are not read.
    """
    manifest = write(pages, scratch_folder(pages.sparkSession), least_bytes)
    return read(manifest, with_block=False).where("problem is null").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ROUND_TRIP_SQL = """
with p as (
    select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first,
           cast(cast(unhex(sha1(coalesce(html, ''))) as bit) as varchar) as bits
    from pages)
select page_id, cast(strlen(html) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
           16 * cast(substr(bits, 5 * k + 1, 1) as int) + 8 * cast(substr(bits, 5 * k + 2, 1) as int)
           + 4 * cast(substr(bits, 5 * k + 3, 1) as int) + 2 * cast(substr(bits, 5 * k + 4, 1) as int)
           + cast(substr(bits, 5 * k + 5, 1) as int) as int), 1)), '') as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from p
"""
