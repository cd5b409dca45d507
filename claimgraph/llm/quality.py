"""Quality rules: repetition and length, then distribution divergence from the language (operator 6).

The divergence rule compares two histograms of a document with those of its language:
the classes of its characters and its common words.  The distance is Jensen-Shannon's
(root of the divergence to base two, 0 to 1).  The references are sums over all
documents of a language, so every document counts and nothing is sampled.  As the distance
of a text without any common word depends on how many the corpus has, a text also fails
when its share of common words is below LEAST_COMMON of the mean share of the language's
documents that pass the base rules, each with the same weight.

Built-in functions only.  Every rule is computed inside the document's own row; the
only shuffle carries one small row per language and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import SPACES, let, numbered, place, restored, words_of
from claimgraph.session import cut_lineage

WINDOW = 8
MIN_WORDS, MAX_REPEATED_PERCENT = 20, 30
SYMBOLS = "[#*$%&|<>]"
#: Languages with a reference of their own and their common words, in the order of the bins.  The rest share one reference.
COMMON_WORDS: dict[str, tuple[str, ...]] = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "was", "with", "as", "be", "by"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "est", "pour", "dans", "par", "qui", "au"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una"),
}
OTHER = "other"
#: Documents with fewer characters in words, or fewer words, are too short for the histogram and pass that rule.
MIN_CHARS, MIN_COMMON_WORDS = 200, 100
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.3
#: Least share of common words over the mean share of its language.
LEAST_COMMON = 0.1
#: Shares are summed as whole multiples of 1 / SHARE_UNITS, so that no order of rows changes a sum.
SHARE_UNITS = 1_000_000


def _removed(text: Column, characters: str) -> Column:
    """How many characters of ``text`` are in the class."""
    return F.length(text) - F.length(F.regexp_replace(text, f"{characters}+", ""))


def char_histogram(text: Column, n_symbols: Column, word_chars: Column) -> Column:
    """Counts of letters, capitals, digits, symbols, white space and all else."""
    letters, capitals, digits = _removed(text, r"\p{L}"), _removed(text, r"\p{Lu}"), _removed(text, r"\p{N}")
    return let(F.array(letters, capitals, digits, n_symbols, F.length(text) - word_chars, F.length(text)), lambda c: F.array(
        c[0] - c[1], c[1], c[2], c[3], c[4], c[5] - c[0] - c[2] - c[3] - c[4])).cast("array<double>")


def word_histogram(words: Column, language: Column) -> Column:
    """Counts of the language's common words and of all other words; one bin for a language without a list."""
    all_words = sorted({w for ws in COMMON_WORDS.values() for w in ws})
    lists = F.create_map(*[part for lang, ws in COMMON_WORDS.items()
                           for part in (F.lit(lang), F.array(*[F.lit(w) for w in ws]))])
    counted = let(F.filter(words, lambda w: w.isin(all_words)), lambda found: F.transform(
        F.coalesce(lists[language], F.array().cast("array<string>")),
        lambda bin_: F.size(F.filter(found, lambda w: w == bin_))))
    return let(counted, lambda n: F.concat(n, F.array(
        F.size(words) - F.aggregate(n, F.lit(0), lambda a, b: a + b)))).cast("array<double>")


def repeated_words(words: Column, hashes: Column) -> Column:
    """Words inside windows that a text has twice or more.

    ``hashes`` holds one hash per window.  Only a text with equal hashes sorts them; there,
    neighbours with equal hashes are compared word by word.
    """
    def same(a: Column, b: Column) -> Column:
        return (a["h"] == b["h"]) & (F.slice(words, a["i"] + 1, WINDOW) == F.slice(words, b["i"] + 1, WINDOW))

    def twice(s: Column) -> Column:
        last = F.size(s) - 1
        return F.transform(s, lambda x, j: F.when(
            F.when(j > 0, same(x, s[F.greatest(j - 1, F.lit(0))])).otherwise(False)
            | F.when(j < last, same(x, s[F.least(j + 1, last)])).otherwise(False), x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    places = F.sort_array(F.array_compact(let(ordered, twice)))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(places, start, lambda acc, p: F.struct(
        p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(covered)


def _base(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` with ``_t`` (text), ``_w`` (words), ``_l`` (language) and the counts that the histograms need."""
    lang = F.col("lang").cast("string")
    return (docs.withColumns({"_t": F.coalesce(F.col("text").cast("string"), F.lit("")),
                              "_l": F.when(lang.isin(list(COMMON_WORDS)), lang).otherwise(OTHER)})
            .withColumn("_w", words_of(F.col("_t"), SPACES))
            .withColumns({"_chars": F.length(F.array_join("_w", "")), "_symbols": _removed(F.col("_t"), SYMBOLS)})
            .withColumns({"_ch": char_histogram(F.col("_t"), F.col("_symbols"), F.col("_chars")),
                          "_wh": word_histogram(F.col("_w"), F.col("_l"))}))


def _figures(docs: DataFrame) -> DataFrame:
    """``_base`` with the other figures of the base rules and ``_failed``."""
    size, n_repeat = F.size("_w"), "_repeat"
    hashes = F.when(size >= WINDOW, F.transform(F.sequence(F.lit(1), F.greatest(size - WINDOW + 1, F.lit(1))),
                                                lambda i: F.xxhash64(F.slice("_w", i, WINDOW)))).otherwise(
        F.array().cast("array<bigint>"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return (_base(docs).withColumn("_h", hashes)
            .withColumns({n_repeat: repeated_words(F.col("_w"), F.col("_h")), "_n": size,
                          "_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))})
            .withColumn("_failed", (F.col("_n") < MIN_WORDS) | (100 * F.col(n_repeat) > MAX_REPEATED_PERCENT * F.col("_n"))))


def references(figures: DataFrame) -> DataFrame:
    """(lang, chars, words, common): summed histograms of all documents per language and the mean share of common words.

    One row per listed language and ``other``.  The mean is that of the documents that
    pass the base rules, null where none does.
    """
    bins = {"_ch": 6, "_wh": 1 + max(map(len, COMMON_WORDS.values()))}
    units = F.when(~F.col("_failed"), F.round(common_share(F.col("_wh")) * SHARE_UNITS).cast("bigint"))
    sums = figures.groupBy(F.col("_l").alias("lang")).agg(
        *[F.sum(F.get(F.col(c), F.lit(k))).alias(f"{c}{k}") for c, n in bins.items() for k in range(n)],
        (F.sum(units) / F.nullif(F.count(units), F.lit(0)) / SHARE_UNITS).alias("common"))
    return sums.select("lang", *[F.array_compact(F.array(*[f"{c}{k}" for k in range(n)])).alias(name)
                                 for (c, n), name in zip(bins.items(), ("chars", "words"), strict=True)], "common")


def distance(counts: Column, reference: Column) -> Column:
    """Jensen-Shannon distance of two histograms; zero where one is empty."""
    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)

    def term(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(0.0)

    def shares(x: Column) -> Column:
        return let(total(x), lambda n: F.transform(x, lambda v: v / n))

    divergence = total(F.zip_with(shares(counts), shares(reference), lambda p, q: (
        term(p, (p + q) / 2) + term(q, (p + q) / 2)) / 2))
    return F.when((total(counts) > 0) & (total(reference) > 0), F.sqrt(F.greatest(divergence, F.lit(0.0)))).otherwise(0.0)


def common_share(counts: Column) -> Column:
    """The share of all bins but the last; zero for an empty histogram."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, b: a + b)
    return F.when(total > 0, 1 - F.try_element_at(counts, F.lit(-1)) / total).otherwise(0.0)


def judged(figures: DataFrame) -> DataFrame:
    """The rows of ``figures`` with distances and ``_kept``.

    A null text has no words and fails; a null or unlisted language is held against the
    reference of all such documents; other columns pass through, whatever their names;
    repeated rows are judged each; an empty table gives an empty one.
    """
    refs = references(figures).select(F.col("lang").alias("_l"), F.col("chars").alias("_rc"), F.col("words").alias("_rw"),
                                      F.col("common").alias("_rs"))
    # The references have one row per listed language and one more, a bound that does not depend on the data.
    return (figures.join(F.broadcast(refs), "_l", "left")
            .withColumns({"_char_distance": distance(F.col("_ch"), F.col("_rc")),
                          "_word_distance": distance(F.col("_wh"), F.col("_rw")),
                          "_few_common": common_share(F.col("_wh")) < LEAST_COMMON * F.coalesce("_rs", F.lit(0.0))})
            .withColumn("_kept", ~F.col("_failed")
                        & ((F.col("_chars") < MIN_CHARS) | (F.col("_char_distance") <= MAX_CHAR_DISTANCE))
                        & ((F.col("_n") < MIN_COMMON_WORDS)
                           | ((F.col("_word_distance") <= MAX_WORD_DISTANCE) & ~F.col("_few_common")))))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) per document."""
    # The figures without the texts are small; written once, they serve the references and the verdicts.
    figures = cut_lineage(_figures(docs.select("doc_id", "text", "lang")).select(
        "doc_id", "_n", "_chars", "_symbols", "_dup_lines", "_repeat", "_failed", "_l", "_ch", "_wh"))
    return judged(figures).select(
        "doc_id", *[F.col(c).cast("bigint").alias(name) for c, name in (
            ("_n", "n_words"), ("_chars", "word_chars"), ("_symbols", "n_symbols"), ("_dup_lines", "n_dup_lines"),
            ("_repeat", "n_repeat_words"))], F.col("_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass all rules, other columns unchanged, whatever their names; see ``judged`` for nulls.

    The rows are written once with their small figures, which serve the references and the verdicts.
    """
    plain = numbered(docs)
    own = plain.select(*plain.columns, F.col(place(docs, "text")).alias("text"), F.col(place(docs, "lang")).alias("lang"))
    figures = cut_lineage(_figures(own).select(*plain.columns, "_n", "_chars", "_failed", "_l", "_ch", "_wh"))
    # A filter is moved below the projections it reads from with all their expressions written
    # out, lambdas too, unless a projection is not deterministic; the row number keeps it above.
    rows = judged(figures).withColumn("_number", F.monotonically_increasing_id())
    return restored(rows.where(F.col("_kept") & (F.col("_number") >= 0)), docs)
