import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from odd_rows import TEXTS, rows_of

from claimgraph.llm import byte_bpe as B


@pytest.fixture(scope="module")
def bpe():
    return B.ByteBpe.from_file(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def truth():
    pairs = map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_hash_is_minimal_and_refuses_foreign_words(bpe):
    table = bpe.hash
    assert len(set(table.keys)) == len(table.keys) == table.size
    assert all(table.get(k) == v for k, v in zip(table.keys, table.values, strict=True))
    assert table.get(b"no such token here") == -1 and table.get(b"") == -1


def test_hash_of_small_sets():
    for n in (0, 1, 2, 3, 7):
        keys = [bytes([k]) for k in range(n)]
        table = B.PerfectHash(keys, list(range(n)))
        assert [table.get(k) for k in keys] == list(range(n)) and table.get(b"zz") == -1


def test_random_texts_encode_as_the_library_does(bpe, truth):
    letters, draw = list("ab  \n\t\r'stréñ.,!1２\x1c\x85\xa0　日本😀​"), random.Random(3)
    for _ in range(3000):
        text = "".join(draw.choice(letters) for _ in range(draw.randrange(40)))
        ids = bpe.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == truth.encode_ordinary(text), text
        assert bpe.decode(ids) == text.encode()


def test_full_memories_change_nothing(bpe, truth, monkeypatch):
    monkeypatch.setattr(B, "MEMORY_WORDS", 6)
    fresh = B.ByteBpe(bpe.prepare().ranks, bpe.pattern)
    for text in ("a b c d e f g a b c", TEXTS[5], TEXTS[7]):
        assert np.frombuffer(fresh.encode(text), "<u4").tolist() == truth.encode_ordinary(text)


def test_memory_is_bounded_by_bytes(bpe, truth, monkeypatch):
    monkeypatch.setattr(B, "MEMORY_BYTES", 4000)
    fresh = B.ByteBpe(bpe.prepare().ranks, bpe.pattern)
    text = " ".join(f"wörd{k}, {k % 7}" for k in range(500))
    assert np.frombuffer(fresh.encode(text), "<u4").tolist() == truth.encode_ordinary(text)
    memory = fresh.splitter.memory
    assert memory.held <= 4000 // 2 + 400 and len(memory) + len(memory.older) < 20


def test_ids_without_a_token_are_refused(bpe):
    with pytest.raises((TypeError, IndexError)):
        B.ByteBpe({b"a": 3}, bpe.pattern).decode(np.array([1], "<u4").tobytes())
    with pytest.raises((TypeError, IndexError)):
        bpe.decode(np.array([1 << 31], "<u4").tobytes())


def test_one_pass_gives_what_two_give(odd_docs, no_docs, bpe, monkeypatch):
    monkeypatch.setattr(B, "FLUSH_BYTES", 50)
    for docs in (odd_docs, no_docs):
        one = B.round_trip(docs, bpe)
        two = B.decode(B.encode(docs, bpe), bpe)
        assert one.columns == two.columns == ["doc_id", "ids", "decoded"] and rows_of(one) == rows_of(two)


def test_rows(odd_docs, no_docs, bpe, truth):
    want = []
    for doc_id, text in [*TEXTS.items(), (9, "one"), (None, "no id here at all")]:
        ids = truth.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert rows_of(B.digests(odd_docs, bpe)) == sorted(want, key=repr)
    assert rows_of(B.digests(no_docs, bpe)) == []


def test_neighbouring_texts_encode_as_each_alone(bpe, truth, monkeypatch):
    letters, draw = list("ab  \n\t'sé.,!1\x85　日😀"), random.Random(5)
    texts = [None, "", *("".join(draw.choice(letters) for _ in range(draw.randrange(60))) for _ in range(800)), "x" * 200 + " y"]
    for chunk, words in ((1, 600_000), (300, 600_000), (300, 20), (1 << 20, 6)):
        monkeypatch.setattr(B, "CHUNK_CHARS", chunk)
        monkeypatch.setattr(B, "MEMORY_WORDS", words)
        found = list(B.ByteBpe(bpe.prepare().ranks, bpe.pattern).encode_all(texts))
        assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [truth.encode_ordinary(t or "") for t in texts]


def test_a_word_before_a_comma_is_merged_once(bpe):
    # The word was merged again behind a space, before a comma and in a text of its own.
    merged = []
    cut = B.SplitEncoder(B.PretokenEncoder(bpe.pattern, lambda token: merged.append(token) or bpe.pretoken(token)))
    bpe.prepare()
    texts = ["A zqxvw zqxvw, (zqxvw) a.", "A zqxvw. zqxvw,"]
    assert list(cut.texts(texts)) == [bpe.encode(t) for t in texts]
    assert merged.count(" zqxvw") == 1


def test_a_space_may_be_a_pretoken_of_its_own():
    letters = B.ByteBpe({bytes([k]): k for k in range(256)}, r"[a-z]+|\s")
    assert [bytes(np.frombuffer(i, "<u4").tolist()) for i in letters.encode_all(["a b  c d", "a  b"])] == [b"a b  c d", b"a  b"]
