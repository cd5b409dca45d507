import io
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from odd_rows import TEXTS, rows_of
from tokenizers import Tokenizer

from claimgraph.llm import byte_bpe as B
from claimgraph.llm import token_files as F

PATH = P.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [128, 1280, 128 * 77])
def test_blocks_come_back(n):
    draw = np.random.default_rng(n)
    for ids in (draw.zipf(1.2, n) % 70000, np.full(n, 7), draw.integers(0, 2**32, n), np.arange(n)):
        ids = ids.astype(np.uint32)
        data, sizes = F.encode_blocks(ids)
        assert len(data) == sizes.sum()
        assert (F.decode_blocks(data, np.cumsum(sizes) - sizes) == ids).all()


def test_rare_large_ids_are_exceptions():
    ids = np.ones(128, np.uint32)
    ids[5] = 40000
    data, _ = F.encode_blocks(ids)
    head = np.frombuffer(data[:6], F.HEAD)[0]
    assert head["width"] == 0 and head["odd"] == 1 and len(data) == 6 + 5


def test_files_keep_documents(monkeypatch):
    monkeypatch.setattr(F, "FLUSH_IDS", 256)
    draw = np.random.default_rng(5)
    docs = [(None, 3), (1, 0), (2, 1), (2, 1), (5, 5000), (9, 127), (10, 0)]
    out, want = io.BytesIO(), []
    writer = F.Writer(out)
    for doc_id, n in docs:
        ids = draw.integers(0, 50000, n).astype(np.uint32)
        want.append((doc_id, ids.tolist()))
        writer.add(doc_id, ids)
    writer.close()
    got = [(d, ids.tolist()) for d, ids in F.read_file(pa.BufferReader(out.getvalue()))]
    assert got == want


@pytest.mark.parametrize("file_bytes", [64 << 20, 5000])
def test_round_trip(odd_docs, no_docs, file_bytes):
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    texts = [(None, "no id here at all"), *sorted([*TEXTS.items(), (9, "one")])]
    want, start = [], 0
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(F.round_trip(odd_docs, PATH, 2, P.PATTERN, file_bytes)) == sorted(want, key=repr)
    if file_bytes > 5000:
        assert rows_of(F.round_trip(no_docs, PATH, 2, P.PATTERN)) == []


def test_special_token_strings_are_text(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id bigint, text string")
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    n = len(tokenizer.encode("a <|endoftext|> b", add_special_tokens=False).ids) + 1
    assert F.round_trip(docs, PATH, 2, P.PATTERN).first()["n_tokens"] == n


def test_added_tokens_have_their_ids_as_by_the_library(spark):
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>  b\n<|endoftext|>", "<|endoftext| >", "plain", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    tokenizer, want, start = Tokenizer.from_file(PATH), [], 0
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [505, 220, 50256, 734]
    for k, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((k, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows_of(F.round_trip(docs, PATH, 2, P.PATTERN, added_tokens=True)) == want


def test_the_query_knows_added_tokens(spark, tmp_path):
    from claimgraph.llm import queries

    spark.createDataFrame([(1, "one <|endoftext|> two")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op5_token_files(spark, str(tmp_path)).first()["n_tokens"] == 5


def test_texts_of_a_batch_share_their_pieces(monkeypatch):
    # Every piece of every text was looked up and its ids joined by themselves.
    letters, draw = list("ab  \n\t'sé.,!1\x85　日😀"), random.Random(5)
    texts = [None, "", " ", "a", *("".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(400)), "x" * 200 + " y",
             "one <|endoftext|> two", "y" * 100, None]
    tokenizer = Tokenizer.from_file(PATH)
    want = [np.array((tokenizer.encode(t or "", add_special_tokens=False).ids) + [2], "<u2").tobytes() for t in texts]
    bare = Tokenizer(tokenizer.model)
    bare.pre_tokenizer = tokenizer.pre_tokenizer
    pack = lambda text: np.array(bare.encode(text, add_special_tokens=False).ids, "<u2").tobytes()
    asked = []

    def alone(text):
        asked.append(text)
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()

    for words in (600_000, 6):
        monkeypatch.setattr(B, "MEMORY_WORDS", words)
        splitter = B.SplitEncoder(B.PretokenEncoder(P.PATTERN, pack))
        column = pa.array([None, "before", *texts])
        got = F.encode_texts(column.slice(2), splitter, alone, ["<|endoftext|>"], np.array([2], "<u2").tobytes())
        got.validate(full=True)
        assert got.to_pylist() == want
        assert "one <|endoftext|> two" in asked and "x" * 200 + " y" not in asked and "a" not in asked
    nothing = F.encode_texts(pa.array([], pa.string()), splitter, alone, [], b"\2\0")
    assert nothing.to_pylist() == [] and nothing.type == pa.binary()


def test_chunks_of_texts_change_nothing(odd_docs, monkeypatch):
    want = rows_of(F.round_trip(odd_docs, PATH, 2, P.PATTERN))
    monkeypatch.setattr(F, "CHUNK_BYTES", 1)
    run = F.encode(odd_docs, PATH, 2, [], P.PATTERN)
    lengths = sorted(len(r["ids"]) // 2 for r in run.collect())
    assert lengths == sorted(r[2] for r in want)
