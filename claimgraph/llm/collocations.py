"""Phrase collocation mining by top-order marginalisation (operator 11).

The text is read for the longest windows only: from every word on, five lead columns hold the
words that follow inside the piece, padded at its end.  ROLLUP over those columns sums them to
every shorter prefix, so one aggregation counts phrases of all lengths, the words and all words
of a language, where n-gram explosions would emit each text five times.

Most windows of five are unique and cannot be in a phrase that occurs a hundred times.  So pairs,
then triples of frequent pairs, are counted first, by a hash, and a window is padded after the last
word that frequent ones lead to.  Every phrase of at least the wanted count consists of frequent
pairs and triples and stands in its windows whole; a collision of hashes, or a false hit of a filter
that carries the frequent ones, only leaves a window longer.  No count depends on either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ranking import top_per_key
from claimgraph.session import cut_lineage

LONGEST, LEAST, BEST = 5, 100, 2000
NO_LANGUAGE = "und"
BREAKS = b".,;:!?\n\x0b\x0c\r"
#: A piece ends at this token, which no word can be.
END = b"."
_TO_END = bytes.maketrans(BREAKS, END * len(BREAKS))
#: Runs of words up to this length are counted ahead of the windows.
AHEAD = 3
#: Words that a task holds before it sends counts on.
HELD = 1 << 18
#: Distinct words that a worker remembers.
REMEMBERED = 100_000
#: Bits and probes of a filter for each frequent run, and its largest size (8 MB); beyond it, windows stay longer.
BITS_PER_RUN, PROBES, MOST_BITS = 16, 4, 1 << 26
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the argument moves every bit of the result."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words(dict):
    """Numbers of distinct words in the order they are met; number 0 is the end of a piece."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes: list[int] = []
        self[END]

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number


def words_in(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a text, with an end after each piece."""
    marked = (text or b"").lower().translate(_TO_END).replace(END, b" . ")
    return [*marked.split(), END]  # bytes: A-Z; only spaces and tabs are left to split at


def numbered_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, Words, np.ndarray]]:
    """(language, words, their numbers) of runs of texts (lang, text) of one language; all that is held is bounded by ``HELD`` but for one text."""
    words, held, n = Words(), {}, 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found = words_in(text.as_py())
            held.setdefault(language, []).extend(map(words.__getitem__, found))
            n += len(found)
            if n >= HELD or len(words) > REMEMBERED:
                for name, ids in held.items():
                    yield name, words, np.array(ids, np.int64)
                held, n = {}, 0
                if len(words) > REMEMBERED:
                    words = Words()
    for name, ids in held.items():
        yield name, words, np.array(ids, np.int64)


def runs_of(language: str, words: Words, ids: np.ndarray, filters: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length from 2 to ``size``: hashes of the runs of words that start at each place, and whether they may be
    frequent, which needs all shorter ones inside them to be in ``filters``; without a filter of the length, all others may."""
    hashes = np.array(words.hashes, np.uint64)[ids]
    run, inside = mixed(hashes + np.uint64(xxhash.xxh64_intdigest(language.encode()))), ids > 0
    for length in range(2, size + 1):
        run = mixed(run[:-1] * _GOLDEN + hashes[length - 1:])
        inside = inside[:-1] & inside[1:]
        if length - 2 < len(filters):
            inside[inside] = in_filter(run[inside], filters[length - 2])
        yield run, inside


def read(docs: DataFrame) -> DataFrame:
    """(lang, text) as the tasks read it; the text in bytes."""
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col("text").cast("string").cast("binary").alias("text"))


def frequent_runs(texts: DataFrame, filters: list[np.ndarray], least: int) -> DataFrame:
    """(run): hashes of runs one word longer than those of the last filter that occur at least ``least`` times in a language, and of
    any that collide with such."""
    size = len(filters) + 2

    def run(batches):
        for language, words, ids in numbered_texts(batches):
            for hashes, inside in runs_of(language, words, ids, filters, size):
                pass
            found, n = np.unique(hashes[inside], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n, pa.int64())], ["run", "n"])

    counts = texts.mapInArrow(run, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= least).select("run")


def probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Places of a hash in a filter of ``bits`` bits, a power of two."""
    step = mixed(hashes) | np.uint64(1)
    for k in range(PROBES):
        yield (hashes + np.uint64(k) * step) & np.uint64(bits - 1)


def run_filter(runs: DataFrame) -> np.ndarray:
    """A Bloom filter of ``runs``, 64 bits a number: at most ``MOST_BITS`` bits come to the driver, however many runs there are."""
    wanted = max(64, runs.count() * BITS_PER_RUN)
    bits = min(1 << int(wanted - 1).bit_length(), MOST_BITS)

    def run(batches):
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.unique(np.concatenate(list(probes(found, bits))))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)),
                                              pa.array((place & np.uint64(63)).astype(np.int32))], ["at", "bit"])

    cells = (runs.mapInArrow(run, "at int, bit int").groupBy("at")
             .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("cell")).toArrow())
    out = np.zeros(bits // 64, np.uint64)
    out[cells.column("at").to_numpy()] = cells.column("cell").to_numpy().view(np.uint64)
    return out


def in_filter(hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
    hit = np.ones(len(hashes), bool)
    for place in probes(hashes, len(cells) * 64):
        hit &= (cells[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
    return hit


def windows(texts: DataFrame, filters: list[np.ndarray], longest: int) -> DataFrame:
    """(lang, w1 .. w<longest>, n): windows that start at every word, padded with empty words where no frequent run leads on."""
    names = [f"w{k + 1}" for k in range(longest)]

    def run(batches):
        for language, words, ids in numbered_texts(batches):
            leads = [ids]
            reached = np.ones(len(ids), bool)
            frequent = [inside for _, inside in runs_of(language, words, ids, filters, len(filters) + 1)]
            for k in range(1, longest):
                # Place i of a lead column is place i + k of the text, while the run that ends there is frequent.
                size = min(k + 1, len(filters) + 1)
                ends = frequent[size - 2][k + 1 - size:] if filters else ids[k:] > 0
                reached[:len(ends)] &= ends
                reached[len(ends):] = False
                lead = np.zeros_like(ids)
                lead[:-k] = ids[k:]
                leads.append(np.where(reached, lead, 0))
            kept = ids > 0
            code = ids[kept]
            # Windows are numbered exactly, column by column, so that equal ones fall together.
            for lead in leads[1:]:
                code = np.unique(code * len(words.hashes) + lead[kept], return_inverse=True)[1]
            _, first, n = np.unique(code, return_index=True, return_counts=True)
            known = pa.array([b"", *list(words)[1:]], pa.binary())
            columns = [known.take(pa.array(lead[kept][first])) for lead in leads]
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), *columns, pa.array(n, pa.int64())],
                                             ["lang", *names, "n"])

    return texts.mapInArrow(run, "lang string, " + ", ".join(f"{w} binary" for w in names) + ", n bigint")


def phrase_counts(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """(lang, words, phrase, f): phrases of 1 to ``longest`` words that occur ``least`` times, and all words together as 0 words.

    Complete and exact for every phrase of at least ``least`` occurrences, overlaps included.
    """
    texts = read(docs)
    filters: list[np.ndarray] = []
    for _ in range(2, min(AHEAD, longest) + 1):
        filters.append(run_filter(cut_lineage(frequent_runs(texts, filters, least))))
    names = [f"w{k + 1}" for k in range(longest)]
    # Equal windows of different tasks fall together before ROLLUP writes each of them once a prefix.
    whole = windows(texts, filters, longest).groupBy("lang", *names).agg(F.sum("n").alias("n"))
    lang = F.col("lang").alias("of")
    level = F.grouping_id().alias("level")
    sums = whole.rollup(lang, *names).agg(F.sum("n").alias("f"), level)
    # A level has one bit for each column summed away, from the last one on: 0 holds whole windows, all bits but one hold a language.
    length = longest - F.bit_count("level").cast("int")
    padded = F.coalesce(*[F.when(F.col("words") == k + 1, F.col(w) == F.lit(b"")) for k, w in enumerate(names)], F.lit(False))
    phrase = F.concat_ws(" ", *[F.when(F.col("words") > k, F.col(w).cast("string")) for k, w in enumerate(names)])
    return (sums.withColumn("words", length).where(F.col("words") >= 0).where(~padded)
            .where((F.col("words") == 0) | (F.col("f") >= least))
            .select(F.col("of").alias("lang"), "words", phrase.alias("phrase"), "f"))


def _part(phrase: Column, start: int, length: Column | int) -> Column:
    return F.concat_ws(" ", F.slice(F.split(phrase, " "), start, length))


def scored(counts: DataFrame, share: int = 100) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases of two words or more, at their worst cut.

    A phrase goes if a longer one that holds it has at least ``share`` percent of its occurrences.
    Of a chain of longer phrases the one with a single word more has the most, so only those are asked.
    """
    phrases = counts.where("words >= 2").withColumnRenamed("f", "a")
    parts = counts.where("words >= 1")
    totals = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    longer = phrases.where("words >= 3").select(
        "lang", F.explode(F.array(_part(F.col("phrase"), 1, F.col("words") - 1), _part(F.col("phrase"), 2, F.col("words") - 1)))
        .alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = (phrases.join(longer, ["lang", "phrase"], "left")
            .where(F.col("held").isNull() | (F.lit(100) * F.col("held") < F.lit(share) * F.col("a"))))
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.withColumn("first", _part(F.col("phrase"), 1, F.col("k"))).withColumn(
        "rest", F.concat_ws(" ", F.expr("slice(split(phrase, ' '), k + 1, words - k)")))
    joined = (cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
              .join(parts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
              .join(totals, "lang"))
    # Products reach 38 digits; the quotient is at most ten times the words of the language.
    whole = joined.withColumn("score", F.expr(
        "cast((1000BD * cast(a as decimal(18, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(18, 0)) * cast(r as decimal(18, 0))) as bigint)"))
    worst = F.min_by(F.struct("l", "r", "n", "score"), F.struct("score", "k"))
    return whole.groupBy("lang", "phrase", "a").agg(worst.alias("cut")).select("lang", "phrase", "a", "cut.*")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, share: int = 100) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``best`` phrases.

    A null text is empty; a null language is ``und``, together with documents that say so.  Repeated
    rows count as often as they occur.  Ties of score and occurrences go to the phrase that is smaller
    in UTF-8 bytes.  A language without such a phrase, and an empty table, give no row; other columns
    are not read.
    """
    found = scored(cut_lineage(phrase_counts(docs, least, longest)), share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    ranked = top_per_key(found, ["lang"], order, best, "rank")
    return ranked.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations_sql(least: int = LEAST, longest: int = LONGEST, best: int = BEST) -> str:
    """Checking SQL: every phrase of every length is listed and counted."""
    return f"""
with pieces as (
    select coalesce(lang, 'und') as lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                        '[.,;:!?\\x0A-\\x0D]')) as piece
    from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') as w from pieces),
g as (
    select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) as phrase
    from w, range(1, {longest + 1}) as t(k)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as w from f where k >= 2 and f >= {least}),
inner_ as (
    select c.lang, unnest(list_transform(range(1, c.k - j + 2), lambda i: array_to_string(c.w[i:i + j - 1], ' '))) as phrase, c.a
    from c, range(2, {longest}) as t(j) where j < c.k),
longer as (select lang, phrase, max(a) as held from inner_ group by all),
kept as (select c.* from c left join longer using (lang, phrase) where held is null or 100 * held < 100 * a),
cuts as (
    select lang, phrase, a, j, array_to_string(w[1:j], ' ') as first_, array_to_string(w[j + 1:k], ' ') as rest
    from kept, range(1, {longest}) as t(j) where j < k),
s as (
    select cuts.lang, cuts.phrase, a, j, x.f as l, y.f as r, n::bigint as n,
           ((1000::hugeint * a * n::hugeint) // (x.f::hugeint * y.f))::bigint as score
    from cuts join f x on x.lang = cuts.lang and x.phrase = first_ join f y on y.lang = cuts.lang and y.phrase = rest
         join n on n.lang = cuts.lang),
worst as (select * from s qualify row_number() over (partition by lang, phrase order by score, j) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from worst
qualify rank <= {best}
"""
