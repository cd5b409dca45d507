"""Byte-level BPE encoding and decoding (operator 1).

A text is cut into pre-tokens.  Tier one is a minimal perfect hash over the
vocabulary, which resolves a pre-token that is itself a token in one probe.  Tier
two merges the bytes of every other pre-token: linked symbols and a heap of
mergeable pairs, lowest rank and leftmost first, O(n log n) in its bytes.

Texts repeat their words, so each worker remembers what a word encoded to; the
memory is bounded by bytes, older words leave it and it never changes a result.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from claimgraph.llm.common import add_columns, map_batches

# Spaces as the pattern's \s has them (White_Space).
WHITE = "\t-\r \x85\xa0  -     　"
WHITES = frozenset(chr(c) for c in (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
MEMORY_WORDS = 600_000
MEMORY_WORD_CHARS = 80
#: Bound of the memory of pieces by its estimated bytes, that of other pre-tokens has a third: ENTRY_BYTES for the objects and table places, four a character, and the ids.
MEMORY_BYTES = 144 << 20
ENTRY_BYTES = 200
#: The new words of about this many characters of texts are encoded together.
CHUNK_CHARS = 1 << 20
#: Ids of about this many bytes go back to Spark at a time.
FLUSH_BYTES = 4 << 20


class PerfectHash:
    """Minimal perfect hash: ``n`` keys in ``n`` slots, one displacement per bucket of two to three keys.

    Buckets are placed largest first; a bucket of one key names its slot directly
    (a negative displacement).  The slot keeps its key, so foreign words are refused.
    """

    def __init__(self, keys: list[bytes], values: list[int]):
        n = len(keys)
        self.size, self.buckets = n, max(1, n * 2 // 5)
        hashes = [xxh3_64_intdigest(k) for k in keys]
        groups: list[list[int]] = [[] for _ in range(self.buckets)]
        for at, h in enumerate(hashes):
            groups[h % self.buckets].append(at)
        slots = [-1] * n
        self.shift = [0] * self.buckets
        free_from = 0
        for b in sorted(range(self.buckets), key=lambda g: -len(groups[g])):
            group = groups[b]
            if not group:
                break
            if len(group) == 1:
                while slots[free_from] >= 0:
                    free_from += 1
                slots[free_from] = group[0]
                self.shift[b] = -free_from - 1
                continue
            d = 0
            while True:
                wanted = {self._slot(hashes[at], d): at for at in group}
                if len(wanted) == len(group) and all(slots[s] < 0 for s in wanted):
                    break
                d += 1
            for s, at in wanted.items():
                slots[s] = at
            self.shift[b] = d
        self.keys = [keys[at] for at in slots]
        self.values = [values[at] for at in slots]

    def _slot(self, h: int, d: int) -> int:
        mixed = (h ^ d * 0x9E3779B97F4A7C15) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
        return (mixed ^ mixed >> 31) % self.size

    def get(self, key: bytes) -> int:
        """The value of ``key``, or -1."""
        if not self.size:
            return -1
        h = xxh3_64_intdigest(key)
        d = self.shift[h % self.buckets]
        slot = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[slot] if self.keys[slot] == key else -1


class Generations(dict):
    """A bounded memory: when it is full it becomes the older half, and what is used again comes back from there."""

    def __init__(self, make: Callable[[str], bytes | None], share: float = 1.0):
        super().__init__()
        self.make, self.older, self.held = make, {}, 0
        self.words, self.bytes = int(share * MEMORY_WORDS), int(share * MEMORY_BYTES)

    def __missing__(self, key: str) -> bytes | None:
        out = self.older[key] if key in self.older else self.make(key)
        if len(key) <= MEMORY_WORD_CHARS:
            self.make_room()
            self[key] = out
            self.held += ENTRY_BYTES + 4 * len(key) + len(out or b"")
        return out

    def make_room(self) -> None:
        if len(self) >= self.words // 2 or self.held >= self.bytes // 2:
            self.older = dict(self)
            self.clear()
            self.held = 0

    def keep(self, found: dict[str, bytes]) -> None:
        self.make_room()
        self.update(found)
        self.held += ENTRY_BYTES * len(found) + 4 * sum(map(len, found)) + sum(map(len, found.values()))


def touches_white(piece: str) -> bool:
    """Whether a piece is empty, or starts or ends with white space, which then belongs to a longer run."""
    return not piece or piece[0] in WHITES or piece[-1] in WHITES


class PretokenEncoder:
    """Encodes a piece that starts and ends between pre-tokens; the pre-tokens of a composed piece are remembered."""

    def __init__(self, pattern: str, encode: Callable[[str], bytes]):
        # What starts with a space is mostly remembered by the caller, without it.
        self.encode, self.memory = encode, Generations(encode, 1 / 3)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]")
                                   .replace(r"\s", f"[{WHITE}]")).findall

    def __call__(self, piece: str) -> bytes:
        found = self.split(piece)
        # A piece of one pre-token is remembered by the caller, once.
        return self.encode(found[0]) if len(found) == 1 else b"".join(map(self.memory.__getitem__, found))


class SplitEncoder:
    """Encodes whole texts piece by piece.

    A single space between two other characters always starts a pre-token, so the text
    may be cut there.  Texts with other white space around a space are cut by the
    coarse pattern, whose cuts are all cuts of the full one as well.
    """

    def __init__(self, encode: PretokenEncoder):
        self.encode = encode
        # None marks a piece that must not be encoded by itself.
        self.memory = Generations(lambda piece: None if touches_white(piece) else encode(" " + piece))
        self.coarse = regex.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")

    def text(self, text: str | None) -> bytes:
        return self._join(text, text.split(" ")) if text else b""

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """``text`` of each; the new pieces of neighbouring texts are learned together."""
        waiting, held = [], 0
        for text in texts:
            waiting.append((text, text.split(" ") if text else []))
            held += len(text or "")
            if held >= CHUNK_CHARS:
                yield from self._flush(waiting)
                waiting, held = [], 0
        yield from self._flush(waiting)

    def _flush(self, waiting: list[tuple[str | None, list[str]]]) -> Iterator[bytes]:
        self.learn(set().union(*[pieces[1:] for _, pieces in waiting]))
        for text, pieces in waiting:
            yield self._join(text, pieces) if text else b""

    def learn(self, pieces: Iterable[str]) -> None:
        """Remember what ``pieces`` encode to, cutting all new ones in one pass of the pattern.

        Where they stand behind single spaces, every pre-token that starts with a space is the first of
        its piece; without the space it is a key of the same memory.
        """
        memory, tails, encode = self.memory, self.encode.memory, self.encode.encode
        older = memory.older
        new = [p for p in pieces if p not in memory and p not in older and len(p) <= MEMORY_WORD_CHARS and not touches_white(p)]
        found = self.encode.split(" " + " ".join(new)) if new else []
        done: dict[str, bytes] = {}  # the memory may forget while it learns
        at, code = -1, b""
        for token in found:
            if token[0] == " ":
                if at >= 0:
                    done[new[at]] = code
                at += 1
                key = token[1:]
                code = done.get(key) or memory.get(key) or older.get(key)
                if code is None:
                    code = encode(token)
                    if key:  # a pattern may have the space as a pre-token of its own
                        done[key] = code
            else:
                code += tails[token]
        if found:
            done[new[at]] = code
        memory.keep(done)

    def _join(self, text: str, pieces: list[str]) -> bytes:
        memory, first = self.memory, pieces[0]
        if not touches_white(first):
            try:
                return self.encode(first) + b"".join(map(memory.__getitem__, pieces[1:]))
            except TypeError:  # a piece that is not to be encoded by itself
                pass
        return b"".join([memory[c[1:]] if c[0] == " " and not touches_white(c[1:])
                         else self.encode(c) for c in self.coarse.findall(text)])


class ByteBpe:
    """Vocabulary of ranks with both tiers; ids are packed as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.hash = PerfectHash(list(ranks), list(ranks.values()))
        self.longest = max(map(len, ranks), default=0)

    @classmethod
    def from_file(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def __getstate__(self):
        return {"pattern": self.pattern, "hash": self.hash, "longest": self.longest}

    def prepare(self) -> ByteBpe:
        """Tables that each worker builds once for itself."""
        if not hasattr(self, "splitter"):
            self.ranks = dict(zip(self.hash.keys, self.hash.values, strict=True))
            # An id that no token has stays None, which fails to join.
            self.tokens: list[bytes | None] = [None] * (1 + max(self.hash.values, default=-1))
            for token, rank in self.ranks.items():
                self.tokens[rank] = token
            self.no_rank = -1
            self.pair_ranks = [self.ranks.get(bytes(divmod(pair, 256)), -1) for pair in range(65536)]
            self.splitter = SplitEncoder(PretokenEncoder(self.pattern, self.pretoken))
        return self

    def merge(self, word: bytes) -> list[int]:
        """Ids of a word by merging its bytes: linked symbols and a heap of pairs.

        A heap entry packs (rank, start, end) into one integer, which orders like the triple.
        """
        rank, n, longest, no = self.ranks.get, len(word), self.longest, self.no_rank
        wide = max(12, n.bit_length())
        low, up = (1 << wide) - 1, 2 * wide
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = self.pair_ranks
        heap = [(r << wide | i) << wide | i + 2 for i, (a, b) in enumerate(zip(word, word[1:]))
                if (r := pairs[a << 8 | b]) != no]
        heapify(heap)
        while heap:
            top = heappop(heap)
            end, i = top & low, top >> wide & low
            middle = after[i]
            # Both symbols must still stand as they did: i starts one, and its neighbour ends at ``end``.
            if middle >= n or middle < 0 or after[middle] != end:
                continue
            after[i], after[middle] = end, -1
            if end < n:
                before[end] = i
                reach = after[end]
                if reach - i <= longest and (r := rank(word[i:reach], no)) != no:
                    heappush(heap, r << up | i << wide | reach)
            left = before[i]
            if left >= 0 and end - left <= longest and (r := rank(word[left:end], no)) != no:
                heappush(heap, r << up | left << wide | end)
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(rank(word[i:end]))
            i = end
        return ids

    def pretoken(self, token: str) -> bytes:
        raw = token.encode()
        whole = self.hash.get(raw)
        ids = [whole] if whole >= 0 else self.merge(raw)
        return self.pack(ids)

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.prepare().splitter.text(text)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        return self.prepare().splitter.texts(texts)

    def decode(self, ids: bytes | None) -> bytes:
        return b"".join(map(self.prepare().tokens.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    A null or empty text gives no ids (an empty binary), a null id stays null, repeated
    rows are encoded each, other columns are not read; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batch):
        vocabulary = shared.value
        ids = pa.array(vocabulary.encode_all(t.as_py() for t in batch.column(1)), pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["id", "ids"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, ids binary").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, bpe: ByteBpe, ids_col: str = "ids") -> DataFrame:
    """The rows of ``encoded`` and ``decoded``, the bytes its ids stand for; null ids decode to no bytes."""
    shared = encoded.sparkSession.sparkContext.broadcast(bpe)
    at = encoded.columns.index(ids_col)

    def run(batch):
        vocabulary = shared.value
        out = pa.array([vocabulary.decode(i.as_py()) for i in batch.column(at)], pa.binary())
        yield add_columns(batch, decoded=out)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return map_batches(encoded, run, f"{fields}, decoded binary")


def round_trip(docs: DataFrame, bpe: ByteBpe, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): ``decode`` of ``encode`` in one pass, so a task has one worker with one vocabulary.

    Rows, nulls and empty tables are treated as ``encode`` and ``decode`` treat them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bpe)

    def run(batch):
        vocabulary, done, held, ids, decoded = shared.value, 0, 0, [], []

        def rows():
            return pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(ids)), pa.array(ids, pa.binary()),
                                               pa.array(decoded, pa.binary())], ["id", "ids", "decoded"])

        for code in vocabulary.encode_all(text.as_py() for text in batch.column(1)):
            ids.append(code)
            decoded.append(vocabulary.decode(ids[-1]))
            held += len(ids[-1])
            if held >= FLUSH_BYTES:
                yield rows()
                done, held, ids, decoded = done + len(ids), 0, [], []
        if ids:
            yield rows()

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return map_batches(rows, run, f"id {kind}, ids binary, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, bpe: ByteBpe) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of the encoded and decoded texts."""
    return round_trip(docs, bpe).select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
