import random
import zlib

import numpy as np
from odd_rows import rows_of
from pyspark.sql import functions as F

from claimgraph.llm import language as L

SYLLABLES = {"aa": ["ka", "to", "mi", "re"], "bb": ["sch", "ung", "ein", "zu"], "cc": ["ção", "nh", "lho", "ém"]}


def corpus(n=240):
    draw = random.Random(2)
    out = []
    for k in range(n):
        lang = sorted(SYLLABLES)[k % 3]
        text = " ".join("".join(draw.choice(SYLLABLES[lang]) for _ in range(draw.randrange(1, 4))) for _ in range(draw.randrange(5, 60)))
        out.append((k, text, lang))
    return out


def test_counts_do_not_depend_on_the_piece_size(monkeypatch):
    text = "Größe, 日本 and some more" * 7
    whole = L.counts(text)
    for size in (1, 2, 5, 64):
        monkeypatch.setattr(L, "CHARS_AT_ONCE", size)
        assert (L.counts(text) == whole).all()
    assert whole.sum() == sum(len(text) - order + 1 for order in L.ORDERS)


def test_penalties_keep_weights_sparse():
    learner = L.Ftrl(2)
    learner.learn(np.array([3, 5]), np.array([1e-3, 0.9]), 1)
    w = learner.weights()
    assert w[1, 5] > 0 > w[0, 5] and (w[:, 3] == 0).all() and np.count_nonzero(w) == 2


def test_temperature_finds_the_scale():
    draw = np.random.default_rng(0)
    scores = draw.normal(0, 2, (4000, 3))
    labels = np.array([draw.choice(3, p=L.softmax(s)) for s in scores])
    assert abs(L.temperature(scores * 4, labels) - 4) < 0.6
    assert L.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4)
    got = {r["doc_id"]: r for r in L.identify(docs).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 4 == 2]
    assert sorted(k for k, r in got.items() if r["held_out"]) == held
    assert np.mean([got[k]["lang_pred"] == rows[k][2] for k in held]) > 0.97
    assert all(0 < r["score"] <= 1 for r in got.values())


def test_held_out_labels_are_not_read(spark):
    rows = corpus()
    lied = [(k, t, "zz" if zlib.crc32(str(k).encode()) % 4 == 2 else lang) for k, t, lang in rows]
    make = lambda r: rows_of(L.identify(spark.createDataFrame(r, "doc_id bigint, text string, lang string").repartition(4)))
    assert make(rows) == make(lied)


def test_odd_rows(spark, odd_docs, no_docs):
    got = {r["doc_id"]: r for r in L.identify(odd_docs).collect()}
    assert {k for k, r in got.items() if r["lang_pred"] == "und"} == {0, 1, 2, 10}
    assert got[0]["score"] == 0 and got[3]["lang_pred"] == "en" and got[None]["held_out"] is False
    assert rows_of(L.identify(no_docs)) == []
    unlabelled = L.identify(spark.createDataFrame([(1, "text", None)], "doc_id bigint, text string, lang string"))
    assert rows_of(unlabelled.select("lang_pred", "score")) == [("und", 0.0)]
    kept = L.keep_identified(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == len(got) + 1 - 4


def texts_of(letters, n, draw):
    return [" ".join("".join(draw.choice(letters) for _ in range(4)) for _ in range(8)) for _ in range(n)]


def test_every_language_is_learned(spark):
    draw = random.Random(3)
    alphabets = {f"l{k:02d}": [chr(0x4E00 + 40 * k + j) for j in range(12)] for k in range(100)}
    rows = [(lang, text) for lang, letters in alphabets.items() for text in texts_of(letters, 3 if lang > "l05" else 6, draw)]
    model = L.train(spark.createDataFrame([(k, text, lang) for k, (lang, text) in enumerate(rows)], "doc_id bigint, text string, lang string"))
    assert model.languages == sorted(alphabets)


def test_null_and_repeated_ids_are_rows(spark, monkeypatch):
    draw = random.Random(5)
    rows = [(None, text, "none") for text in texts_of("abcd", 30, draw)] + [(7, text, "same") for text in texts_of("wxyz", 30, draw)]
    rows += [(k, text, "each") for k, text in enumerate(texts_of("mnop", 30, draw))] + [(None, "abcd dcba", "none")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(3)
    counted = {r["lang"]: r["n"] for r in L.sample(docs).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert counted == {"none": 31, "same": 30, "each": 30}
    assert {r["part"] for r in L.sample(docs).where("lang = 'none'").collect()} == {0, 1, 2, 3, 4}
    model = L.train(docs)
    assert model.predict("dacb bcda abdc")[0] == "none" and model.predict("zwyx yxwz")[0] == "same" and model.predict("mopn")[0] == "each"
    monkeypatch.setattr(L, "SAMPLE_ROWS", 30)
    assert {r["n"] for r in L.sample(docs).groupBy("lang").agg(F.count("*").alias("n")).collect()} == {10}
