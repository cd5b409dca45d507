import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from odd_rows import TEXTS, rows_of

from claimgraph.llm import language
from claimgraph.llm import lattice as L


@pytest.fixture(scope="module")
def vocabulary():
    return L.Vocabulary.from_file(P.path("piece_bpe_32k.model"))


def segmentations(v, s):
    """Every way to cut the marked word into pieces, as lists of piece numbers."""
    if not s:
        yield []
        return
    for j in range(1, len(s) + 1):
        if s[:j] in v.index:
            for rest in segmentations(v, s[j:]):
                yield [v.index[s[:j]], *rest]
    if s[0] not in v.index:
        for rest in segmentations(v, s[1:]):
            yield [*(v.bytes[b] for b in s[0].encode()), *rest]


def test_forward_sums_all_segmentations(vocabulary):
    v = vocabulary.prepare()
    for word in ("", "the", "thentien", "éleè", "日本a", "a\x00b"):
        want = sum(math.prod(v.weights[k] for k in s) for s in segmentations(v, L.START + word))
        assert v.log_probability(word) == pytest.approx(math.log(want), rel=1e-12)


@pytest.mark.parametrize("least", [1e-250, 2.0])
def test_expected_pieces_are_those_of_all_segmentations(vocabulary, monkeypatch, least):
    monkeypatch.setattr(L, "LEAST_PLAIN", least)
    v = vocabulary.prepare()
    for word in ("thentien", "日a"):
        ways = list(segmentations(v, L.START + word))
        p = [math.prod(v.weights[k] for k in s) for s in ways]
        want = Counter()
        for s, x in zip(ways, p, strict=True):
            for k in s:
                want[k] += 3 * x / sum(p)
        into = [0.0] * len(v.pieces)
        v.expected(word, into, 3)
        assert {k: pytest.approx(x) for k, x in want.items()} == {k: x for k, x in enumerate(into) if x}


def test_long_words_do_not_underflow(vocabulary):
    assert -1e6 < vocabulary.log_probability("ab" * 5000) < -1000


def test_weights_are_probabilities_and_improve(spark, vocabulary):
    rows = [(b"the", 50, 50), (b"thentien", 5, 5), (b"unseen", 0, 1)]
    counted = spark.createDataFrame([(bytearray(w), c, n) for w, c, n in rows], "word binary, c bigint, n bigint")
    likelihoods = []
    for rounds in (0, 1, 3):
        v = L.estimate(counted, vocabulary, 4, rounds)
        assert v.weights.sum() == pytest.approx(1) and (v.weights > 0).all()
        likelihoods.append(sum(c * v.log_probability(w.decode()) for w, c, _ in rows) + 4 * math.log(v.weights[-1]))
    assert likelihoods == sorted(likelihoods)


def check(docs, df, vocabulary, head=None):
    held = {d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in docs}
    tokens = {k: (t or "").encode().lower().split() + [b""] for k, (_, t) in enumerate(docs)}
    counts = Counter(w for k, (d, _) in enumerate(docs) if not held[d] for w in tokens[k])
    total, distinct = sum(counts.values()), len(counts)
    got = sorted(map(tuple, L.likelihood(df, vocabulary, language.is_held_out(7, 2)).collect()), key=repr)
    want = sorted(((d, held[d], len(tokens[k]), sum(counts[w] > 0 for w in tokens[k]), total,
                    sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in tokens[k]), tokens[k])
                   for k, (d, _) in enumerate(docs)), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert [g[5] for g in got] == [pytest.approx(w[5], rel=1e-9) for w in want]
    words = Counter(w for ws in tokens.values() for w in ws if w)
    rows = spark_rows(df, words, {w: counts[w] for w in words})
    model = L.estimate(rows, vocabulary, sum(not held[d] for d, _ in docs))
    scores = [sum(model.log_probability(x.decode()) for x in w[6][:-1]) + math.log(model.weights[-1]) for w in want]
    assert [g[6] for g in got] == [pytest.approx(s / math.log(10), rel=1e-4) for s in scores]


def spark_rows(df, words, counts):
    return df.sparkSession.createDataFrame([(bytearray(w), counts[w], n) for w, n in words.items()], "word binary, c bigint, n bigint")


@pytest.mark.parametrize("head", [100_000, 5])
def test_documents(spark, vocabulary, monkeypatch, head):
    monkeypatch.setattr(L, "HEAD", head)
    draw = random.Random(6)
    docs = [(k, " ".join("".join(draw.choice(["the", "en", "Ti", "é"]) for _ in range(draw.randrange(1, 4)))
                         for _ in range(draw.randrange(40)))) for k in range(60)]
    docs += [(3, docs[3][1]), (70, "a\x85b c\x1cd\ve")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    check(docs, df, vocabulary)


def test_odd_rows(odd_docs, no_docs, vocabulary):
    docs = [*TEXTS.items(), (9, "one"), (None, "no id here at all")]
    check(docs, odd_docs, vocabulary)
    assert rows_of(L.likelihood(no_docs, vocabulary, language.is_held_out(7, 2))) == []


def test_scores_are_lower_for_longer_texts(vocabulary):
    assert np.isfinite(vocabulary.log_probability("x" * 100)) and vocabulary.log_probability("x" * 100) < vocabulary.log_probability("x")


def test_score_of_a_word_is_the_forward_sum_of_its_arcs():
    pieces = [*(f"<0x{b:02X}>" for b in range(256)), "▁", "▁a", "a", "ab", "abc", "b", "éa", "▁abé", "ca"]
    model, draw = L.Vocabulary(pieces).prepare(), random.Random(2)
    for _ in range(500):
        word = "".join(draw.choice("aabbcéx日") for _ in range(draw.randrange(12)))
        n, arcs = model.arcs(word)
        spelled = "▁" + word
        wanted = [(i, j, pieces.index(spelled[i:j])) for i in range(n) for j in range(i + 1, n + 1) if spelled[i:j] in pieces]
        assert [a for a in arcs if type(a[2]) is int] == wanted
        assert model.log_probability(word) == model.forward(n, arcs)[-1]


@pytest.mark.parametrize("least", [1e-250, 1e-20, 2.0])
def test_words_together_give_what_each_gives_alone(monkeypatch, least):
    monkeypatch.setattr(L, "LEAST_PLAIN", least)
    monkeypatch.setattr(L, "TOGETHER", 70)
    pieces = [*(f"<0x{b:02X}>" for b in range(256)), "▁", "▁a", "a", "ab", "abc", "b", "éa", "▁abé", "ca", "c\na", "\n"]
    draw = random.Random(3)
    words = ["", "\n", "a\n", "\na", "\ud800b", "x" * 101, "ab" * 2000, "日本" * 50, "\U0010ffff", *(
        "".join(draw.choice("aabbcéx日\n") for _ in range(draw.randrange(14))) for _ in range(300))]
    counts = [draw.randrange(1, 9) for _ in words]
    model, want, got = L.Vocabulary(pieces).prepare(), [0.0] * len(pieces), np.zeros(len(pieces))
    for word, count in zip(words, counts, strict=True):
        model.expected(word, want, count)
    model.expected_all(words, counts, got)
    assert got.tolist() == pytest.approx(want, rel=1e-9)
    assert model.log_probabilities(words).tolist() == pytest.approx([model.log_probability(w) for w in words], rel=1e-12)
    model.expected_all([], [], got)
    assert got.tolist() == pytest.approx(want, rel=1e-9) and not len(model.log_probabilities([]))


def test_usual_words_are_not_taken_one_by_one(vocabulary, monkeypatch):
    # Every word's lattice was searched and summed by itself, in each round and once more for its score.
    def one_by_one(*_):
        raise AssertionError("a usual word went through its lattice alone")

    model = vocabulary.prepare()
    for name in ("arcs", "expected", "log_probability"):
        monkeypatch.setattr(type(model), name, one_by_one)
    into = np.zeros(len(model.pieces))
    model.expected_all(["the", "thentien", "éleè", "日本a"], [1, 2, 3, 4], into)
    assert into.sum() > 10 and (model.log_probabilities(["the", "日本a"]) < 0).all()
