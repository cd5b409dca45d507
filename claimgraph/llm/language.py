"""Language identification by sparse multinomial logistic regression (operator 8).

Features are TF-IDF weights of character n-grams, hashed into DIMS slots: 1 + log of the
count in the whole lower-cased text, times the log inverse document frequency, scaled
to length one.  Frequencies are counted over all training documents.  The weights are
learned by follow-the-regularised-leader (per-coordinate steps, elastic net), which
keeps them sparse, from a bounded sample of training documents; a temperature fitted on
a part of the sample that was held back calibrates the probabilities.

Bounds of the sample: at most PER_LANGUAGE rows of each language, and SAMPLE_ROWS over all
languages, which share them evenly but have one row each at least; those with the smallest
hashes of their ids.  Every language is learned; the learner takes 256 KB of the driver for each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.llm.common import add_columns, map_batches, numbered, place, restored

DIMS, ORDERS = 1 << 14, (1, 2, 3)
PER_LANGUAGE, SAMPLE_ROWS = 400, 25_600
EPOCHS, ALPHA, BETA, L1, L2 = 6, 0.5, 1.0, 0.02, 0.1
UNKNOWN = "und"
CHARS_AT_ONCE = 1 << 20


def counts(text: str) -> np.ndarray:
    """Counts of the hashed n-grams of a whole text, in pieces that overlap by what an n-gram needs."""
    out = np.zeros(DIMS, np.int64)
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    longest = max(ORDERS)
    for at in range(0, len(chars), CHARS_AT_ONCE):
        for order in ORDERS:
            stop = min(at + CHARS_AT_ONCE, len(chars) - order + 1)
            if stop <= at:
                continue
            part = chars[at:min(stop + longest, len(chars))]
            h = np.full(stop - at, order * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
            for k in range(order):
                h = (h ^ part[k:k + stop - at]) * np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(15)
            out += np.bincount(h & np.uint32(DIMS - 1), minlength=DIMS)
    return out


def features(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.zeros(DIMS)
    at = tf > 0
    x[at] = (1 + np.log(tf[at])) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


class Ftrl:
    """Follow-the-regularised-leader, proximal form, one state per class and slot."""

    def __init__(self, n_classes: int):
        self.z, self.n = np.zeros((n_classes, DIMS)), np.zeros((n_classes, DIMS))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[:, at], self.n[:, at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        error = softmax(w @ x)
        error[label] -= 1
        g = error[:, None] * x[None, :]
        n = self.n[:, at]
        self.z[:, at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[:, at] = n + g * g


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its calibrated probability; ``und`` and 0 without a letter or a learned language."""
        if not text or not self.languages or not regex.search(r"\p{L}", text):
            return UNKNOWN, 0.0
        p = softmax(self.weights @ features(counts(text), self.idf) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden section over its logarithm.

    Half an example is spread over all classes, so that a held-back part without an
    error does not ask for certainty.
    """
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        log_p = np.log(np.maximum(softmax(scores / np.exp(log_t)), 1e-300))
        return -((1 - spread) * log_p[np.arange(len(labels)), labels] + spread * log_p.mean(axis=1)).mean()

    spread = 0.5 / (len(labels) + 1)
    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many documents each slot occurs, and of how many; DIMS counts per task reach the driver, summed by Spark."""
    def run(batches):
        seen, n = np.zeros(DIMS, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                seen += counts(text.as_py() or "") > 0
                n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, DIMS)), pa.array(np.append(n, seen))], ["slot", "n"])

    rows = docs.select(F.col("text").cast("string")).mapInArrow(run, "slot bigint, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).collect()
    out = np.zeros(DIMS, np.int64)
    for slot, n in rows:
        if slot >= 0:
            out[slot] = n
    return out, next((n for slot, n in rows if slot < 0), 0)


def sample(labelled: DataFrame) -> DataFrame:
    """(part, lang, text): the bounded sample; part 0 of 5 is for calibration.

    Rows are chosen by ids and digests of texts, so only chosen texts are shuffled; equal rows
    count once, rows that share an id or have none are told apart by their texts.
    """
    rows = labelled.withColumn("digest", F.xxhash64("text"))
    known = rows.select("doc_id", "lang", "digest").distinct()
    n_languages = labelled.agg(F.count_distinct("lang")).first()[0]
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // max(1, n_languages)))
    key = F.xxhash64(F.col("doc_id").cast("string"))
    chosen = top_per_key(known, ["lang"], [key, F.col("doc_id"), F.col("digest")], each)
    # At most the larger of SAMPLE_ROWS and the number of languages, whatever the data.
    chosen = F.broadcast(chosen.select(F.col("doc_id").alias("id"), F.col("lang").alias("l"), F.col("digest").alias("d")))
    found = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("lang") == F.col("l")) & (F.col("digest") == F.col("d")), "left_semi")
    once = found.groupBy("doc_id", "lang", "digest").agg(F.first("text").alias("text"))
    named = F.coalesce(F.col("doc_id").cast("string"), F.col("digest").cast("string"))
    return once.select(F.pmod(F.xxhash64(F.lit("part"), named), F.lit(5)).alias("part"), "lang", "text")


def train(labelled: DataFrame) -> Model:
    """A model from (doc_id, text, lang) with non-null languages; null ids are rows as any; without any rows it predicts nothing."""
    labelled = labelled.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    seen, n = document_frequency(labelled)
    idf = np.log((1 + n) / (1 + seen)) + 1

    def run(batch):
        rows = [features(counts(t.as_py() or ""), idf) for t in batch.column(2)]
        at = [np.flatnonzero(x) for x in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1),
                                          pa.array([a.astype("<u2").tobytes() for a in at], pa.binary()),
                                          pa.array([x[a].astype("<f4").tobytes() for x, a in zip(rows, at, strict=True)], pa.binary())],
                                         ["part", "lang", "at", "x"])

    rows = map_batches(sample(labelled), run, "part bigint, lang string, at binary, x binary").collect()
    data = sorted((r["part"], r["lang"], bytes(r["at"]), bytes(r["x"])) for r in rows)
    languages = sorted({lang for _, lang, _, _ in data})
    examples = [(part, languages.index(lang), np.frombuffer(at, "<u2"), np.frombuffer(x, "<f4").astype(np.float64))
                for part, lang, at, x in data]
    learner, order = Ftrl(len(languages)), np.random.default_rng(0)
    fitted = [e for e in examples if e[0]] or examples
    for _ in range(EPOCHS):
        for k in order.permutation(len(fitted)).tolist():
            _, label, at, x = fitted[k]
            learner.learn(at, x, label)
    weights = learner.weights()
    held = [e for e in examples if not e[0]]
    scores = np.array([weights[:, at] @ x for _, _, at, x in held])
    return Model(languages, idf, weights, temperature(scores, np.array([label for _, label, _, _ in held])))


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """The rows of ``docs`` and the predicted language and score of their whole texts; only the text is read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batch):
        found = [shared.value.predict(t.as_py()) for t in batch.column(at)]
        yield add_columns(batch, a=pa.array([lang for lang, _ in found], pa.string()), b=pa.array([p for _, p in found], pa.float64()))

    # Positions, not names, carry the columns, so equal names may stand beside each other.
    fields = ", ".join(f"c{k} {f.dataType.simpleString()}" for k, f in enumerate(docs.schema))
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return map_batches(plain, run, f"{fields}, a string, b double").toDF(*docs.columns, lang_name, score_name)


def is_held_out(folds: int = 4, fold: int = 2):
    """Whether a document is outside the training set; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds == fold


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) per document.

    A null text, or one without a letter, is ``und`` with score 0, and so is every text
    when no document is labelled; repeated rows repeat; an empty table gives an empty one;
    columns of other names are not read.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), "lang")
    model = train(rows.where(~is_held_out() & F.col("lang").isNotNull()))
    return predict(rows.select("doc_id", is_held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is predicted with at least probability ``least``.

    A null text, or one without a letter, goes; a null id or language stays if its text is
    recognised; repeated rows are judged each; other columns pass through unchanged,
    whatever their names; an empty table gives an empty one.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"), "lang")
    model = train(rows.where(~is_held_out() & F.col("lang").isNotNull()))
    found = predict(numbered(docs), model, place(docs, "text"))
    return restored(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)), docs)
