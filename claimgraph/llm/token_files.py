"""Token ids in binary files of patched frame-of-reference blocks (operator 5).

File format, all numbers little-endian:

    magic "PFB1"
    blocks, one after the other; a block holds BLOCK ids (the last one is padded with its minimum):
        minimum u32, width u8, exceptions u8,
        packed   BLOCK * width bits of (id - minimum), lowest bits first, 64-bit words
        position u8 per exception, value u32 (id - minimum) per exception
    block starts   u64 per block, counted from the start of the file
    documents      id i64, flags u8 (1: the id is null), ids of it u64; one record each, in order
    footer         u64 blocks, u64 documents, u64 ids, u64 place of the block starts

A block's width is the bit length of its values at percentile PERCENTILE; what needs
more bits stands in the exception list and its packed bits are zero.
"""

from __future__ import annotations

import sys
import uuid
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.llm.byte_bpe import PretokenEncoder, SplitEncoder, touches_white
from claimgraph.llm.common import map_batches, open_folder
from claimgraph.sources.files import scratch_folder

MAGIC, BLOCK, PERCENTILE = b"PFB1", 128, 0.9
HEAD = np.dtype([("low", "<u4"), ("width", "u1"), ("odd", "u1")])
DOC = np.dtype([("id", "<i8"), ("flags", "u1"), ("n", "<u8")])
FOOT = np.dtype(("<u8", (4,)))
FLUSH_IDS = 1 << 20
FILE_BYTES = 64 << 20
#: Texts of about this many bytes are cut and put together at a time.
CHUNK_BYTES = 8 << 20


def bit_length(values: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.int64)


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """(m, BLOCK) values below 2**width to (m, BLOCK*width/8) bytes."""
    words = np.zeros((BLOCK * width // 64, len(values)), np.uint64)
    for k, column in enumerate(np.ascontiguousarray(values.T).astype(np.uint64)):
        at, shift = divmod(k * width, 64)
        words[at] |= column << np.uint64(shift)
        if shift + width > 64:
            words[at + 1] |= column >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(values), -1)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of ``pack``."""
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").astype(np.uint64).T)
    out, mask = np.zeros((BLOCK, len(packed)), np.uint64), np.uint64((1 << width) - 1)
    for k in range(BLOCK if width else 0):
        at, shift = divmod(k * width, 64)
        column = words[at] >> np.uint64(shift)
        if shift + width > 64:
            column = column | words[at + 1] << np.uint64(64 - shift)
        out[k] = column & mask
    return out.T


def encode_blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Blocks of a whole number of BLOCK ids, and the size of each block."""
    rows = ids.reshape(-1, BLOCK)
    low = rows.min(axis=1)
    over = rows - low[:, None]
    width = bit_length(np.sort(over, axis=1)[:, int(np.ceil(PERCENTILE * BLOCK)) - 1])
    odd = over >> width[:, None].astype(np.uint32) != 0
    n_odd = odd.sum(axis=1)
    sizes = HEAD.itemsize + BLOCK // 8 * width + 5 * n_odd
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint8)
    head = np.zeros(len(rows), HEAD)
    head["low"], head["width"], head["odd"] = low, width, n_odd
    out[starts[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(len(rows), -1)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        packed = pack(np.where(odd[at], 0, over[at]), w)
        out[starts[at, None] + HEAD.itemsize + np.arange(packed.shape[1])] = packed
    block, position = np.nonzero(odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    base = (starts + HEAD.itemsize + BLOCK // 8 * width)[block]
    out[base + nth] = position
    values = over[block, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    out[(base + n_odd[block] + 4 * nth)[:, None] + np.arange(4)] = values
    return out.tobytes(), sizes


def decode_blocks(data: bytes, starts: np.ndarray) -> np.ndarray:
    """All ids of the blocks that start at ``starts`` in ``data``."""
    raw = np.frombuffer(data, np.uint8)
    head = np.ascontiguousarray(raw[starts[:, None] + np.arange(HEAD.itemsize)]).view(HEAD)[:, 0]
    width, n_odd = head["width"].astype(np.int64), head["odd"].astype(np.int64)
    over = np.zeros((len(starts), BLOCK), np.uint64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        over[at] = unpack(raw[starts[at, None] + HEAD.itemsize + np.arange(BLOCK // 8 * w)], w)
    block = np.repeat(np.arange(len(starts)), n_odd)
    nth = np.arange(len(block)) - np.repeat(np.cumsum(n_odd) - n_odd, n_odd)
    base = (starts + HEAD.itemsize + BLOCK // 8 * width)[block]
    values = np.ascontiguousarray(raw[(base + n_odd[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4")[:, 0]
    over[block, raw[base + nth]] = values
    return (over + head["low"][:, None]).astype(np.uint32).ravel()


class Writer:
    """Streams documents into one file; holds about FLUSH_IDS ids and 17 bytes a document."""

    def __init__(self, out):
        self.out, self.at = out, len(MAGIC)
        self.waiting: list[np.ndarray] = []
        self.n_waiting = self.n_ids = 0
        self.starts: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= FLUSH_IDS:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        if last and len(ids) % BLOCK:
            tail = ids[len(ids) // BLOCK * BLOCK:]
            ids = np.concatenate([ids, np.full(BLOCK - len(tail), tail.min(), np.uint32)])
        whole = len(ids) // BLOCK * BLOCK
        if whole:
            data, sizes = encode_blocks(ids[:whole])
            self.starts.append(self.at + np.cumsum(sizes) - sizes)
            self.at += len(data)
            self.out.write(data)
        self.waiting, self.n_waiting = [ids[whole:]], len(ids) - whole

    def close(self) -> None:
        self._flush(True)
        starts = np.concatenate([*self.starts, np.zeros(0, np.int64)]).astype("<u8")
        self.out.write(starts.tobytes())
        self.out.write(np.array(self.docs, DOC).tobytes())
        self.out.write(np.array([len(starts), len(self.docs), self.n_ids, self.at], "<u8").tobytes())


def read_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """(document id, its ids) in order; reads about FLUSH_IDS ids at a time through the block starts."""
    size = source.size()
    source.seek(size - FOOT.itemsize)
    n_blocks, n_docs, n_ids, place = np.frombuffer(source.read(FOOT.itemsize), "<u8").tolist()
    source.seek(place)
    starts = np.frombuffer(source.read(8 * n_blocks), "<u8").astype(np.int64)
    docs = np.frombuffer(source.read(DOC.itemsize * n_docs), DOC)
    ends = np.append(starts[1:], place)
    have, done, block = np.zeros(0, np.uint32), 0, 0
    for doc_id, flags, n in docs.tolist():
        parts, need = [], n
        while need > len(have):
            parts.append(have)
            need -= len(have)
            upto = min(block + FLUSH_IDS // BLOCK, n_blocks)
            source.seek(int(starts[block]))
            data = source.read(int(ends[upto - 1] - starts[block]))
            have = decode_blocks(data, starts[block:upto] - starts[block])
            have, block = have[:n_ids - done], upto
            done += len(have)
        parts.append(have[:need])
        have = have[need:]
        yield None if flags & 1 else doc_id, np.concatenate(parts)


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable in Latin-1, else from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


def encode_texts(texts: pa.Array, splitter: SplitEncoder, alone: Callable[[str], bytes], added: list[str], end: bytes) -> pa.Array:
    """The packed ids of each text and the end id.

    Texts are cut at single spaces and each distinct piece is encoded once.  A text that holds one of
    ``added`` or a piece that must not be encoded by itself goes whole to ``alone``.
    """
    n = len(texts)
    cut = pc.split_pattern(texts, " ")
    n_pieces = pc.fill_null(pc.list_value_length(cut), 0).to_numpy().astype(np.int64)
    pieces = pc.dictionary_encode(cut.flatten())
    names, which = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy().copy()
    firsts, filled = np.cumsum(n_pieces) - n_pieces, np.flatnonzero(n_pieces)
    later = np.ones(len(which), bool)
    later[firsts[filled]] = False
    asked = np.zeros(len(names), bool)
    asked[which[later]] = True
    memory, asked = splitter.memory, asked.tolist()
    splitter.learn([name for name, behind in zip(names, asked, strict=True) if behind])
    codes = [memory[name] if behind else b"" for name, behind in zip(names, asked, strict=True)]
    row = np.repeat(np.arange(n), n_pieces)
    whole = np.zeros(n, bool)
    whole[row[later & np.array([code is None for code in codes], bool)[which]]] = True
    for token in added:
        whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
    # Behind the pieces' codes come the end's, an empty one, and of every text that of its first piece or of all of it.
    the_end, nothing = len(codes), len(codes) + 1
    codes += [end, b""]
    for k in filled.tolist():
        first = names[which[firsts[k]]]
        whole[k] |= touches_white(first)
        codes.append(alone(texts[k].as_py()) if whole[k] else splitter.encode(first))
    which[whole[row]] = nothing
    which[firsts[filled]] = nothing + 1 + np.arange(len(filled))
    which = np.insert(which, firsts + n_pieces, the_end)
    joined = pa.array(codes, pa.binary()).take(pa.array(which))  # its bytes are those of the texts, one behind the other
    ends = np.append(0, np.cumsum(n_pieces + 1))
    places = np.frombuffer(joined.buffers()[1], np.int32, len(joined) + 1)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(places[ends]), joined.buffers()[2]])


def encode(docs: DataFrame, tokenizer_path: str, end_id: int, bounds: list[int], pattern: str, added_tokens: bool = False) -> DataFrame:
    """(bucket, doc_id, ids): ids of every whole text by the tokenizers library and the end id, u16 or u32 packed.

    ``pattern`` cuts pre-tokens where the library's byte-level step cuts them; the library's
    model encodes each distinct one while a worker remembers it.  With ``added_tokens`` a text
    that quotes one of the tokenizer's added tokens goes to the library whole, which gives
    that token its own id; without, the quotation is text like any other.
    """
    edges = np.array(bounds, np.int64)

    def run(batches):
        from tokenizers import Tokenizer

        tokenizer, letters = Tokenizer.from_file(tokenizer_path), byte_letters()
        kind = ("H", "<u2") if tokenizer.get_vocab_size() <= 1 << 16 else ("I", "<u4")
        # Small lists are packed several times faster by the array type than by NumPy.
        pack_ids = (lambda ids: array(kind[0], ids).tobytes()) if sys.byteorder == "little" else (lambda ids: np.array(ids, kind[1]).tobytes())
        end, tokenize = pack_ids([end_id]), tokenizer.model.tokenize

        def pretoken(token: str) -> bytes:
            if token.isascii() and token.isprintable():  # only the space has another letter
                written = token.replace(" ", letters[32])
            else:
                written = token.encode().decode("latin-1").translate(letters)
            return pack_ids([t.id for t in tokenize(written)])

        splitter = SplitEncoder(PretokenEncoder(pattern, pretoken))
        added = [t.content for t in tokenizer.get_added_tokens_decoder().values()] if added_tokens else []

        def alone(text: str) -> bytes:
            quotes = any(a in text for a in added)
            return pack_ids(tokenizer.encode(text, add_special_tokens=False).ids) if quotes else splitter.text(text)

        lowest = int(edges[0]) if len(edges) else 0
        for batch in batches:
            ids = [lowest if i is None else i for i in batch.column(0).to_pylist()]
            buckets = pa.array(np.searchsorted(edges, np.array(ids, np.int64)), pa.int32())
            ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            cuts = np.flatnonzero(np.diff(ends // CHUNK_BYTES)) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                part = batch.slice(at, to - at)
                out = encode_texts(part.column(1), splitter, alone, added, end)
                yield pa.RecordBatch.from_arrays([buckets.slice(at, to - at), part.column(0), out], ["bucket", "doc_id", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "bucket int, doc_id bigint, ids binary")


def write(docs: DataFrame, tokenizer_path: str, end_id: int, pattern: str, folder: str, file_bytes: int = FILE_BYTES,
          added_tokens: bool = False) -> DataFrame:
    """Write the encoded documents in ascending id order to files under ``folder``; the manifest of the files.

    Files hold ranges of ids (quantiles, so that a file holds about ``file_bytes`` of text),
    a null id comes first, repeated ids stand side by side.  A task names its file anew in
    every attempt and the manifest, a Parquet table, lists those of the attempts that Spark
    committed, so a repeated task leaves no trace.
    """
    total = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("bytes")).first()["bytes"] or 0
    n_files = int(total // file_bytes) + 1
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), [k / n_files for k in range(1, n_files)] or [0.5],
                                        100 * n_files).alias("cuts")).first()["cuts"]
    bounds = sorted(set(cuts or [])) if n_files > 1 else []
    wide = _wide(tokenizer_path)

    def run(batches):
        fs, path = open_folder(folder)
        fs.create_dir(path)
        bucket, writer, out, name = None, None, None, ""

        def finish():
            writer.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"bucket": bucket, "file": name, "n_docs": len(writer.docs),
                                                "n_ids": writer.n_ids, "n_bytes": fs.get_file_info(name).size}])

        for batch in batches:
            for b, doc_id, ids in zip(*(batch.column(k) for k in range(3)), strict=True):
                if b.as_py() != bucket:
                    if writer:
                        yield finish()
                    bucket = b.as_py()
                    name = f"{path}/tokens-{bucket:06d}-{uuid.uuid4().hex}.pfb"
                    out = fs.open_output_stream(name, compression=None)
                    writer = Writer(out)
                writer.add(doc_id.as_py(), np.frombuffer(ids.as_buffer(), "<u4" if wide else "<u2").astype(np.uint32))
        if writer:
            yield finish()

    encoded = encode(docs, tokenizer_path, end_id, bounds, pattern, added_tokens)
    manifest = (encoded.repartitionById(len(bounds) + 1, F.col("bucket")).sortWithinPartitions("bucket", "doc_id")
                .mapInArrow(run, "bucket bigint, file string, n_docs bigint, n_ids bigint, n_bytes bigint"))
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def _wide(tokenizer_path: str) -> bool:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path).get_vocab_size() > 1 << 16


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): documents of the files; ``start`` counts the ids of all documents before."""
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file: the window orders file totals, not documents.
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))

    def run(batch):
        fs, _ = open_folder(folder)
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            with fs.open_input_file(file) as source:
                rows, held = [], 0
                for doc_id, ids in read_file(source):
                    rows.append({"doc_id": doc_id, "start": start, "n_tokens": len(ids), "ids": ids.astype("<u4").tobytes()})
                    start += len(ids)
                    held += len(ids)
                    if held >= FLUSH_IDS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    n = max(1, manifest.count())
    return map_batches(files.repartition(n, "file"), run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer_path: str, end_id: int, pattern: str, file_bytes: int = FILE_BYTES,
               added_tokens: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of documents written to token files and read back from them.

    A null or empty text is the end id alone; a null id sorts first; an empty table gives
    no file and no row; other columns are not read.
    """
    folder = scratch_folder(docs.sparkSession)
    manifest = write(docs, tokenizer_path, end_id, pattern, folder, file_bytes, added_tokens)
    return read(manifest, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
