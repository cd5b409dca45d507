"""Collocations against a count of all phrases, odd rows, the filter of pairs and exact scores."""

import re
from collections import Counter
from itertools import groupby

import numpy as np
import pytest

from claimgraph.llm import collocations as co
from claimgraph.llm import queries

SF = "/root/testdata/sf0.001"


def pieces(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [[w for w in re.split(r"[\x20\x09]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counted(docs, longest=5):
    f = Counter()
    for lang, text in docs:
        for words in pieces(text):
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang or "und", tuple(words[i:i + k])] += 1
    return f


def brute(docs, least, longest=5, best=2000):
    f = counted(docs, longest)
    n = Counter()
    for (lang, words), c in f.items():
        n[lang] += c if len(words) == 1 else 0
    candidates = {k: c for k, c in f.items() if len(k[1]) > 1 and c >= least}
    longer = Counter()
    for (lang, words), c in candidates.items():
        for i in range(len(words)):
            for j in range(i + 2, len(words) + 1):
                if j - i < len(words):
                    longer[lang, words[i:j]] = max(longer[lang, words[i:j]], c)
    rows = []
    for (lang, words), a in candidates.items():
        if 100 * longer[lang, words] >= 100 * a:
            continue
        cuts = [(1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k) for k in range(1, len(words))]
        score, k = min(cuts)
        rows.append((lang, -score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    out = []
    for lang, group in groupby(sorted(rows), lambda r: r[0]):
        out += [(lang, i + 1, r[3].decode(), -r[2], r[4], r[5], r[6], -r[1]) for i, r in enumerate(group) if i < best]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in co.collocations(df, **options).collect())


@pytest.mark.parametrize("least", [2, 5, 30])
def test_against_all_phrases(spark, least):
    docs = queries.table(spark, SF, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert got(docs, least=least) == brute(rows, least)


@pytest.mark.parametrize("longest", [2, 3])
def test_shorter_windows_and_best(spark, longest):
    docs = queries.table(spark, SF, "documents")
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert got(docs, least=3, longest=longest, best=7) == brute(rows, 3, longest, 7)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = [(r.lang, r.text) for r in odd_docs.collect()]
    for least in (1, 2, 100):
        assert got(odd_docs, least=least) == brute(rows, least)
    assert got(no_docs) == []
    assert co.collocations(no_docs).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_languages_are_apart_and_null_is_und(spark):
    rows = [(1, "Ab cd. AB CD, ab cd", None), (2, "ab cd", "und"), (3, "ab cd\tab cd", "en"), (4, "É é Ab\x0bcd", "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert got(docs, least=2) == brute([(r[2], r[1]) for r in rows], 2)


def test_counts_of_every_length(spark):
    docs = spark.createDataFrame([("x " * 2000 + ". y x y x y", "en")] * 3, "text string, lang string")
    found = {(r.words, r.phrase): r.f for r in co.phrase_counts(docs, 3).collect()}
    f = counted([(r.lang, r.text) for r in docs.collect()])
    assert found.pop((0, "")) == sum(c for (_, w), c in f.items() if len(w) == 1)
    assert found == {(len(w), " ".join(w)): c for (_, w), c in f.items() if c >= 3}


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame(
        [("en", 0, "", 4 * 10 ** 15), ("en", 1, "a", 3 * 10 ** 12 + 1), ("en", 1, "b", 2 * 10 ** 12 + 7), ("en", 2, "a b", 10 ** 12 + 3)],
        "lang string, words int, phrase string, f bigint")
    row = co.scored(counts).first()
    assert row.score == 1000 * (10 ** 12 + 3) * 4 * 10 ** 15 // ((3 * 10 ** 12 + 1) * (2 * 10 ** 12 + 7))


def test_a_filter_has_all_its_pairs_and_a_full_one_changes_nothing(spark, monkeypatch):
    rng = np.random.default_rng(1)
    pairs = rng.integers(-2 ** 63, 2 ** 63, 5000)
    cells = co.run_filter(spark.createDataFrame([(int(p),) for p in pairs], "run bigint"))
    assert co.in_filter(pairs.view(np.uint64), cells).all()
    assert co.in_filter(rng.integers(0, 2 ** 63, 5000).astype(np.uint64), cells).mean() < 0.02
    docs = queries.table(spark, SF, "documents")
    want = got(docs, least=5)
    monkeypatch.setattr(co, "MOST_BITS", 64)
    assert got(docs, least=5) == want


@pytest.mark.parametrize("ahead", [1, 2, 4])
def test_runs_counted_ahead_change_nothing(spark, monkeypatch, ahead):
    docs = queries.table(spark, SF, "documents")
    want = got(docs, least=5)
    monkeypatch.setattr(co, "AHEAD", ahead)
    assert got(docs, least=5) == want


def test_runs_of_any_size_and_forgotten_words_change_nothing(spark, monkeypatch):
    docs = queries.table(spark, SF, "documents")
    want = got(docs, least=5)

    def small(batches, real=co.numbered_texts):
        for name, value in (("HELD", 500), ("REMEMBERED", 300)):
            real.__globals__[name] = value
        return real(batches)
    monkeypatch.setattr(co, "numbered_texts", small)
    assert got(docs, least=5) == want
