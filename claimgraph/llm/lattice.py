"""Language-model scores by subword lattice likelihood (operator 7).

The vocabulary is an existing one and is not changed.  A word is the lattice of all its
segmentations into pieces of that vocabulary (a character without a piece of its own
falls back to byte pieces); its probability is the sum over all of them, by a forward
recursion in log space.  Pieces do not cross words, so the lattice of a document is the
chain of its words' lattices and of one end symbol, and its log probability their sum.

The piece weights start from the order of the vocabulary and are re-estimated on all
training words: each round spreads a word's count over its segmentations by forward and
backward sums.

At scale: words are counted once, in the tasks and then by word.  A word's lattice is
computed once for all its occurrences, together with those of some thousand other words.  Words that make up at least one in HEAD of all
words, at most HEAD of them, go to every task; documents meet the rest in a join on the
word, whose keys are rare by that choice, so none of them is hot.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import UPPER, map_batches
from claimgraph.session import cut_lineage

HEAD, HEAD_WORD_BYTES = 100_000, 64
ROUNDS = 2
FLUSH_WORDS = 300_000
START = "▁"
# Below this probability plain products may have lost terms, and a word is summed in log space.
LEAST_PLAIN = 1e-250
# This many words are taken through their lattices together; a word of more characters goes through its own.
TOGETHER, LONG = 10_000, 100
# A character number no text has, behind each of the words taken together.
GAP, WIDE = (1 << 21) - 1, 21


class Vocabulary:
    """Pieces with probabilities; ``weights[-1]`` is the end of a document."""

    def __init__(self, pieces: list[str], weights: np.ndarray | None = None):
        self.pieces, self.weights = pieces, weights
        if weights is None:
            guess = 1 / np.arange(10.0, 11.0 + len(pieces))
            self.weights = guess / guess.sum()

    @classmethod
    def from_file(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        # Texts are lower-cased in A-Z; pieces with those capitals never match and take no weight.
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size())
                    if not model.is_control(i) and not model.is_unknown(i)
                    and (model.is_byte(i) or not set(model.id_to_piece(i)) & set(UPPER))])

    def prepare(self) -> Vocabulary:
        if not hasattr(self, "index"):
            self.index = {p: k for k, p in enumerate(self.pieces)}
            # Prefix tree: character to (number of the piece that ends here or -1, what may follow).
            self.tree: dict[str, list] = {}
            for p, k in self.index.items():
                step = [-1, self.tree]
                for c in p:
                    step = step[1].setdefault(c, [-1, {}])
                step[0] = k
            self.bytes = [self.index.get(f"<0x{b:02X}>") for b in range(256)]
            floor = 1e-12
            self.plain = [max(w, floor) for w in self.weights.tolist()]
            self.logs = [math.log(w) for w in self.plain]
            self._flatten()
        return self

    def _flatten(self) -> None:
        """The tree as arrays: pieces by node, and a hash table from (node, character) to the next node."""
        below, ends, keys = [self.tree], [-1], []
        for node, follow in enumerate(below):  # grows as it goes
            for c, (k, more) in follow.items():
                keys.append(node << WIDE | ord(c))
                below.append(more)
                ends.append(k)
        self.ends, self.weight = np.array(ends, np.int64), np.array(self.plain)
        keys = np.array(keys, np.int64)
        self.shift = np.uint64(64 - max(4, (4 * len(keys)).bit_length()))
        size = 1 << 64 - int(self.shift)
        self.keys, self.nodes = np.full(size, -1), np.zeros(size, np.int64)
        waiting = np.arange(len(keys))
        slots = self._slots(keys)
        while len(waiting):  # of those that want the same free slot the first gets it, the others go on to the next
            at = slots[waiting]
            free = np.flatnonzero(self.keys[at] < 0)
            taken, first = np.unique(at[free], return_index=True)
            placed = waiting[free[first]]
            self.keys[taken], self.nodes[taken] = keys[placed], placed + 1
            waiting = np.setdiff1d(waiting, placed)
            slots[waiting] = (slots[waiting] + 1) % size

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _next(self, nodes: np.ndarray, characters: np.ndarray) -> np.ndarray:
        """The node behind each node by its character, or 0."""
        keys = nodes << WIDE | characters
        slots = self._slots(keys)
        have = self.keys[slots]
        other = np.flatnonzero((have != keys) & (have >= 0))
        while len(other):
            slots[other] = (slots[other] + 1) % len(self.keys)
            have[other] = now = self.keys[slots[other]]
            other = other[(now != keys[other]) & (now >= 0)]
        return np.where(have == keys, self.nodes[slots], 0)

    def arcs(self, word: str) -> tuple[int, list[tuple[int, int, int | tuple[int, ...]]]]:
        """Number of places, and (start, end, piece) of every piece of the marked word by start; byte pieces as a tuple."""
        s = START + word
        n, tree, index = len(s), self.tree, self.index
        out = []
        for i in range(n):
            follow = tree
            for j in range(i, n):
                step = follow.get(s[j])
                if step is None:
                    break
                k, follow = step
                if k >= 0:
                    out.append((i, j + 1, k))
            if s[i] not in index:
                out.append((i, i + 1, self.spelled(s[i])))
        return n, out

    def spelled(self, character: str) -> tuple[int, ...]:
        ids = tuple(self.bytes[b] for b in character.encode("utf-8", "surrogatepass"))
        if None in ids:
            raise ValueError("the vocabulary needs a piece for every byte")
        return ids

    def log_weight(self, piece: int | tuple[int, ...]) -> float:
        return self.logs[piece] if type(piece) is int else sum(self.logs[k] for k in piece)

    def forward(self, n: int, arcs) -> list[float]:
        """Log sums over all segmentations of each prefix."""
        logs, exp, log = self.logs, math.exp, math.log
        alpha = [-math.inf] * (n + 1)
        alpha[0] = 0.0
        for i, j, k in arcs:  # by start, so alpha[i] is whole
            t = alpha[i] + (logs[k] if type(k) is int else self.log_weight(k))
            have = alpha[j]
            if have == -math.inf:
                alpha[j] = t
            elif have > t:
                alpha[j] = have + log(1.0 + exp(t - have))
            else:
                alpha[j] = t + log(1.0 + exp(have - t))
        return alpha

    def log_probability(self, word: str) -> float:
        """What ``forward`` gives for the whole word, without a list of its arcs."""
        self.prepare()
        logs, exp, log, tree, index = self.logs, math.exp, math.log, self.tree, self.index
        s = START + word
        alpha = [-math.inf] * (len(s) + 1)
        alpha[0] = 0.0
        for i, first in enumerate(s):
            before, follow, j = alpha[i], tree, i
            for c in s[i:]:
                step = follow.get(c)
                if step is None:
                    break
                k, follow = step
                j += 1
                if k >= 0:
                    t, have = before + logs[k], alpha[j]
                    if have == -math.inf:
                        alpha[j] = t
                    elif have > t:
                        alpha[j] = have + log(1.0 + exp(t - have))
                    else:
                        alpha[j] = t + log(1.0 + exp(have - t))
            if first not in index:
                t, have = before + self.log_weight(self.spelled(first)), alpha[i + 1]
                alpha[i + 1] = t if have == -math.inf else max(have, t) + log(1.0 + exp(-abs(have - t)))
        return alpha[-1]

    def _lattices(self, words: list[str]):
        """The lattices of ``words`` side by side: first and last place of each, and all arcs.

        Arcs come in groups of one start and length, by start, in the order of ``arcs``; no two of
        a group leave or reach the same place.  An arc has its two places, its weight and its
        piece, or where it spells a character by bytes, -1 less the place of that in a list of byte pieces.
        """
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        last = np.cumsum(sizes) - 1
        first = last - sizes + 1
        joined = START + f"\n{START}".join(words) + "\n"
        characters = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        characters[last] = GAP
        at = np.flatnonzero(characters != GAP)
        nodes, lone = np.zeros(len(at), np.int64), characters != GAP
        found = []
        length = 1
        while len(at):
            nodes = self._next(nodes, characters[at + length - 1])
            on = np.flatnonzero(nodes)
            at, nodes = at[on], nodes[on]
            piece = self.ends[nodes]
            whole = np.flatnonzero(piece >= 0)
            found.append((at[whole], piece[whole], length))
            if length == 1:
                lone[at[whole]] = False
            length += 1
        lone = np.flatnonzero(lone)
        odd, which = np.unique(characters[lone], return_inverse=True)
        spelled = [self.spelled(chr(c)) for c in odd.tolist()]
        odd_weight = np.array([math.prod([self.plain[b] for b in k]) for k in spelled])
        start = np.concatenate([*(a for a, _, _ in found), lone])
        end = np.concatenate([*(a + n for a, _, n in found), lone + 1])
        piece = np.concatenate([*(k for _, k, _ in found), -1 - which])
        weight = np.concatenate([*(self.weight[k] for _, k, _ in found), odd_weight[which]])
        group = np.concatenate([*(np.full(len(a), n) for a, _, n in found), np.full(len(lone), length)])
        group += (start - np.repeat(first, sizes)[start]) * (length + 1)
        order = np.argsort(group, kind="stable")
        cuts = [0, *(np.flatnonzero(np.diff(group[order])) + 1).tolist(), len(order)]
        groups = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        return first, last, start[order], end[order], weight[order], piece[order], groups, spelled

    def _sums(self, first, last, start, end, weight, groups) -> np.ndarray:
        """Sums over all segmentations of each prefix, by place."""
        alpha = np.zeros(int(last[-1]) + 1)
        alpha[first] = 1.0
        for g in groups:
            alpha[end[g]] += alpha[start[g]] * weight[g]
        return alpha

    def log_probabilities(self, words: list[str]) -> np.ndarray:
        """``log_probability`` of each word, to rounding."""
        self.prepare()
        out = np.full(len(words), -math.inf)
        short = [k for k, word in enumerate(words) if len(word) <= LONG]
        for a in range(0, len(short), TOGETHER):
            part = short[a:a + TOGETHER]
            first, last, start, end, weight, _, groups, _ = self._lattices([words[k] for k in part])
            whole = self._sums(first, last, start, end, weight, groups)[last]
            plain = whole >= LEAST_PLAIN
            out[np.array(part)[plain]] = np.log(whole[plain])
        for k in np.flatnonzero(out == -math.inf).tolist():
            out[k] = self.log_probability(words[k])
        return out

    def expected_all(self, words: list[str], counts: list[int], into: np.ndarray) -> None:
        """``expected`` of each word and its count."""
        self.prepare()
        short = [k for k, word in enumerate(words) if len(word) <= LONG]
        alone = [k for k, word in enumerate(words) if len(word) > LONG]
        for a in range(0, len(short), TOGETHER):
            part = short[a:a + TOGETHER]
            first, last, start, end, weight, piece, groups, spelled = self._lattices([words[k] for k in part])
            alpha = self._sums(first, last, start, end, weight, groups)
            plain = alpha[last] >= LEAST_PLAIN
            alone += np.array(part)[~plain].tolist()
            beta = np.zeros(len(alpha))
            beta[last[plain]] = np.array([counts[k] for k in part], float)[plain] / alpha[last[plain]]
            share = np.zeros(len(start))
            for g in reversed(groups):
                t = weight[g] * beta[end[g]]
                share[g] = alpha[start[g]] * t
                beta[start[g]] += t
            own = piece >= 0
            into += np.bincount(piece[own], share[own], len(into))
            for k, x in zip(spelled, np.bincount(-1 - piece[~own], share[~own], len(spelled)).tolist(), strict=True):
                for b in k:
                    into[b] += x
        for k in alone:
            self.expected(words[k], into, counts[k])

    def expected(self, word: str, into, count: float) -> None:
        """Add the expected pieces of ``count`` occurrences of ``word`` to ``into``."""
        n, arcs = self.arcs(word)
        weights = self.plain
        alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
        alpha[0] = 1.0
        for i, j, k in arcs:
            alpha[j] += alpha[i] * (weights[k] if type(k) is int else math.prod([weights[b] for b in k]))
        if alpha[n] < LEAST_PLAIN:
            self._expected_log(n, arcs, into, count)
            return
        beta[n] = count / alpha[n]
        for i, j, k in reversed(arcs):
            if type(k) is int:
                t = weights[k] * beta[j]
                into[k] += alpha[i] * t
            else:
                t = math.prod([weights[b] for b in k]) * beta[j]
                for b in k:
                    into[b] += alpha[i] * t
            beta[i] += t

    def _expected_log(self, n: int, arcs, into, count: float) -> None:
        """The same in log space, for words whose plain products could underflow."""
        alpha, beta = self.forward(n, arcs), [-math.inf] * (n + 1)
        beta[n] = 0.0
        for i, j, k in reversed(arcs):
            t = self.log_weight(k) + beta[j]
            share = count * math.exp(alpha[i] + t - alpha[n])
            for b in (k,) if type(k) is int else k:
                into[b] += share
            top, low = max(beta[i], t), min(beta[i], t)
            beta[i] = top + math.log1p(math.exp(low - top))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces


def decoded(column: pa.Array) -> list[str]:
    return [word.decode("utf-8", "surrogatepass") for word in column.to_pylist()]


def count_words(rows: DataFrame) -> DataFrame:
    """(word, c, n): occurrences in training texts and in all, of ``rows`` (held_out, text)."""
    def run(batches):
        def flush():
            keys = list(every)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([learned[k] for k in keys], pa.int64()),
                                               pa.array(list(every.values()), pa.int64())], ["word", "c", "n"])

        every, learned = Counter(), Counter()
        for batch in batches:
            for held_out, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = words(text.as_py())
                every.update(found)
                if not held_out:
                    learned.update(found)
                if len(every) > FLUSH_WORDS:
                    yield flush()
                    every, learned = Counter(), Counter()
        if every:
            yield flush()

    parts = rows.select("held_out", "text").mapInArrow(run, "word binary, c bigint, n bigint")
    return parts.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def estimate(counted: DataFrame, vocabulary: Vocabulary, n_docs: int, rounds: int = ROUNDS) -> Vocabulary:
    """Piece weights from all training words; each round sums one number per piece and task."""
    n_pieces = len(vocabulary.pieces)
    for _ in range(rounds):
        shared = counted.sparkSession.sparkContext.broadcast(vocabulary)

        def run(batches, shared=shared):
            into = np.zeros(n_pieces)
            for batch in batches:
                shared.value.expected_all(decoded(batch.column(0)), batch.column(1).to_pylist(), into)
            # Whole thousandths add up the same in every order of the tasks.
            yield pa.RecordBatch.from_arrays([pa.array(range(n_pieces), pa.int64()),
                                              pa.array(np.rint(1000 * into).astype(np.int64))], ["piece", "n"])

        sums = (counted.where("c > 0").select("word", "c").mapInArrow(run, "piece bigint, n bigint")
                .groupBy("piece").agg(F.sum("n").alias("n")).collect())
        found = np.full(n_pieces + 1, 0.1)
        for piece, n in sums:
            found[piece] += n / 1000
        found[-1] += n_docs
        vocabulary = Vocabulary(vocabulary.pieces, found / found.sum())
    return vocabulary


def score_words(counted: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, c, n, s): each word's log10 probability by the lattice."""
    shared = counted.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batch):
        s = shared.value.log_probabilities(decoded(batch.column(0))) / math.log(10)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], ["word", "c", "n", "s"])

    return map_batches(counted.select("word", "c", "n"), run, "word binary, c bigint, n bigint, s double")


def score_documents(rows: DataFrame, scored: DataFrame, total: int) -> DataFrame:
    """(row, held_out, n, known, base, s) sums per document over its words; base sums log10(c + 1)."""
    # At most HEAD words can each make up one in HEAD of all.
    head = {bytes(w): (c, math.log10(c + 1), s) for w, c, s in scored.where(
        (F.col("n") * HEAD >= total) & (F.length("word") <= HEAD_WORD_BYTES)).select("word", "c", "s").collect()}
    shared = rows.sparkSession.sparkContext.broadcast(head)

    def run(batch):
        known_words = shared.value
        out = defaultdict(list)
        tail = defaultdict(list)
        for row, doc_id, held_out, text in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            n = known = 0
            base = s = 0.0
            for word, times in Counter(words(text)).items():
                n += times
                hit = known_words.get(word)
                if hit is None:
                    tail["row"].append(row)
                    tail["word"].append(word)
                    tail["times"].append(times)
                else:
                    known += times if hit[0] else 0
                    base += times * hit[1]
                    s += times * hit[2]
            for name, value in (("row", row), ("doc_id", doc_id), ("held_out", held_out), ("n", n), ("known", known), ("base", base), ("s", s)):
                out[name].append(value)
        yield pa.RecordBatch.from_pydict({**out, "word": [None] * batch.num_rows, "times": [0] * batch.num_rows}, schema)
        for at in range(0, len(tail["row"]), 100_000):
            part = {k: v[at:at + 100_000] for k, v in tail.items()}
            size = len(part["row"])
            yield pa.RecordBatch.from_pydict({**part, **{k: [None] * size for k in ("doc_id", "held_out", "n", "known", "base", "s")}}, schema)

    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()),
                        ("base", pa.float64()), ("s", pa.float64()), ("word", pa.binary()), ("times", pa.int64())])
    parts = cut_lineage(map_batches(rows, run, "row bigint, doc_id bigint, held_out boolean, n bigint, known bigint, "
                                               "base double, s double, word binary, times bigint"))
    met = (parts.where("word is not null").select("row", "word", "times")
           .join(scored.select("word", "c", F.col("s").alias("ws")), "word")
           .select("row", F.when(F.col("c") > 0, F.col("times")).otherwise(0).alias("known"),
                   (F.col("times") * F.log10(F.col("c") + 1.0)).alias("base"), (F.col("times") * F.col("ws")).alias("s")))
    blank = {k: F.lit(None).cast(t).alias(k) for k, t in (("doc_id", "bigint"), ("held_out", "boolean"), ("n", "bigint"))}
    every = parts.where("word is null").select("row", "doc_id", "held_out", "n", "known", "base", "s").unionByName(
        met.select("row", *blank.values(), "known", "base", "s"))
    return every.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n").alias("n"),
                                    *[F.sum(k).alias(k) for k in ("known", "base", "s")])


def likelihood(docs: DataFrame, vocabulary: Vocabulary, held_out: Column) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per document.

    Tokens are the words of the whole text with A-Z in lower case, then one end.
    ``base_score`` is the add-one word model, ``score`` the lattice.  Only documents that
    are not held out teach either.  A null or empty text is the end alone; a null
    ``held_out`` counts as false; repeated rows repeat; an empty table gives an empty one.
    Other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    counted = cut_lineage(count_words(rows))
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("c") > 0, 1)), F.lit(0)),
                       F.coalesce(F.sum("n"), F.lit(0))).first()
    n_docs = rows.where("not held_out").count()
    learned, distinct = sums[0] + n_docs, sums[1] + (n_docs > 0)
    model = estimate(counted, vocabulary, n_docs)
    scored = cut_lineage(score_words(counted, model))
    found = score_documents(rows, scored, sums[2])
    below = math.log10(learned + distinct + 1)
    end = float(np.log10(model.weights[-1]))
    return found.select(
        "doc_id", "held_out", (F.col("n") + 1).alias("n_tokens"), (F.col("known") + int(n_docs > 0)).alias("n_known"),
        F.lit(learned).cast("bigint").alias("train_tokens"),
        (F.col("base") + math.log10(n_docs + 1) - (F.col("n") + 1) * F.lit(below)).alias("base_score"),
        (F.col("s") + F.lit(end)).alias("score"))
