"""Splitting documents and filings into chunks.

A document is one row, so its sections, windows and sequence numbers are built
inside the row with array functions: no window, no shuffle, and a document set
of any size streams through one scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import text as tx

WINDOW_WORDS = 400
OVERLAP_WORDS = 50
MIN_WORDS = 80
MIN_CHUNK_CHARS = 200

# Fixed value: a heading between two or three equals signs on its own line.
HEADING = r"(?md)^={2,3}\s*(.+?)\s*={2,3}\s*$".replace(r"\s", tx.WHITE_SPACE_CLASS)

# Fixed value: where a new risk factor starts (capital header, numbered factor, bullet).
RISK_START = (r"(?=\n(?:[A-Z][A-Z" + tx.WHITE_SPACE_CLASS[1:-1] + r",;:\-\.]{10,}\n|Risk Factor \p{Nd}+|[•●]"
              + tx.WHITE_SPACE_CLASS + "))")


def sections(text: Column) -> Column:
    """Section texts: heading line then body; the preamble is kept, empty bodies are not."""
    text = F.coalesce(text, F.lit(""))

    def assemble(parts: Column) -> Column:
        bodies, headings = parts["bodies"], parts["headings"]
        preamble = F.filter(F.array(tx.strip(F.get(bodies, F.lit(0)))), lambda p: p != "")
        rest = F.zip_with(headings, F.slice(bodies, F.lit(2), F.size(headings)),
                          lambda h, b: F.struct(tx.strip(h).alias("h"), tx.strip(b).alias("b")))
        return F.concat(preamble, F.transform(F.filter(rest, lambda s: s["b"] != ""),
                                              lambda s: F.concat(s["h"], F.lit("\n"), s["b"])))

    parts = F.struct(F.split(text, HEADING).alias("bodies"),
                     F.regexp_extract_all(text, F.lit(HEADING), F.lit(1)).alias("headings"))
    return tx.let(tx.let(parts, assemble),
                  lambda found: F.when(F.size(found) > 0, found).otherwise(F.array(text)))


def split_title(section: Column) -> Column:
    """First line as title, the other lines as body.

    A preamble of several lines loses its first line to the title; a section of
    one line keeps it as body too.
    """
    def name(rows: Column) -> Column:
        body = F.when(F.size(rows) > 1, tx.strip(F.array_join(
            F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), "\n"))).otherwise(section)
        return F.struct(tx.strip(F.get(rows, F.lit(0))).alias("title"),
                        F.coalesce(F.nullif(body, F.lit("")), section).alias("body"))

    return tx.let(tx.lines(tx.strip(section)), name)


def windows(text: Column, size: int = WINDOW_WORDS, overlap: int = OVERLAP_WORDS) -> Column:
    """Overlapping word windows; a text of at most ``size`` words stays as it is."""
    step = size - overlap

    def cut(all_words: Column) -> Column:
        last = F.ceil(F.greatest(F.size(all_words) - size, F.lit(0)) / step).cast("int")
        return F.when(F.size(all_words) <= size, F.array(text)).otherwise(F.transform(
            F.sequence(F.lit(0), last),
            lambda i: F.array_join(F.slice(all_words, i * step + 1, size), " ")))

    return tx.let(tx.words(text), cut)


def section_rows(articles: DataFrame) -> DataFrame:
    return articles.select("document_id", F.posexplode(sections(F.col("content")))
                           .alias("section_no", "section"))


def titled_sections(articles: DataFrame) -> DataFrame:
    return (section_rows(articles).withColumn("parts", split_title(F.col("section")))
            .select("document_id", "section_no", F.col("parts.title").alias("section_title"),
                    F.col("parts.body").alias("body")))


def chunk_articles(articles: DataFrame) -> DataFrame:
    """Chunks of articles, numbered from 0 over the chunks that are kept."""
    parts = F.filter(F.transform(sections(F.col("content")), split_title),
                     lambda s: ~tx.is_skipped_section(s["title"]) & ~tx.is_label_list(s["body"]))
    cut = F.flatten(F.transform(parts, lambda s: F.transform(
        windows(s["body"]), lambda w: F.struct(s["title"].alias("section_title"), w.alias("content")))))
    counted = F.transform(cut, lambda c: c.withField("token_estimate", tx.word_count(c["content"])))
    kept = F.filter(counted, lambda c: c["token_estimate"] >= MIN_WORDS)
    return (articles.select("document_id", F.posexplode(kept).alias("sequence", "chunk"))
            .select(chunk_key(F.col("document_id"), F.col("sequence")).alias("chunk_id"),
                    "document_id", "sequence", "chunk.section_title", "chunk.content",
                    "chunk.token_estimate"))


def chunk_key(document_id: Column, sequence: Column) -> Column:
    """A stable id from document and sequence, so a retried task writes the same key."""
    return F.sha2(F.concat_ws(":", document_id.cast("string"), sequence.cast("string")), 256)


def risk_factor_chunks(filings: DataFrame, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Risk-factor pieces; the number in the id counts dropped pieces too."""
    text = F.coalesce(F.col("item1a"), F.lit(""))
    # An empty first piece before a header at the very start is not returned by split.
    shift = F.when(text.rlike(r"\A(?:" + RISK_START + ")"), 1).otherwise(0)
    return (filings.select("cik", "period", shift.alias("shift"),
                           F.posexplode(F.split(text, RISK_START)).alias("pos", "piece"))
            .withColumn("text", tx.strip(F.col("piece")))
            .where(F.length("text") >= min_chars)
            .select(_filing_chunk_id("1a", F.col("pos") + F.col("shift")), F.lit("item1a").alias("source"),
                    "cik", "period", "text", F.length("text").alias("char_count")))


def paragraph_chunks(filings: DataFrame, min_chars: int = MIN_CHUNK_CHARS) -> DataFrame:
    """Paragraphs of item 1; the number in the id counts kept paragraphs only."""
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col("item1"), F.lit("")), "\n\n"), tx.strip),
                          lambda p: F.length(p) >= min_chars)
    return (filings.select("cik", "period", F.posexplode(paragraphs).alias("pos", "text"))
            .select(_filing_chunk_id("1", F.col("pos")), F.lit("item1").alias("source"),
                    "cik", "period", "text", F.length("text").alias("char_count")))


def _filing_chunk_id(item: str, number: Column) -> Column:
    return F.concat_ws("_", "cik", "period", F.lit(item), F.format_string("%04d", number)).alias("chunk_id")


def common_chunks(filings: DataFrame) -> DataFrame:
    """Filing pieces in the shape of article chunks: risk factors first, then paragraphs.

    One filing is one row; its pieces are numbered inside the row, without a shuffle.
    """
    period = tx.period_key(F.col("period"))
    base = filings.withColumn("period", period)
    text = F.coalesce(F.col("item1a"), F.lit(""))
    shift = F.when(text.rlike(r"\A(?:" + RISK_START + ")"), 1).otherwise(0)

    def piece(item: str, source: str):
        return lambda t, i: F.struct(F.lit(item).alias("item"), F.lit(source).alias("source"),
                                     i.alias("number"), tx.strip(t).alias("text"))

    long_enough = lambda p: F.length(p["text"]) >= MIN_CHUNK_CHARS
    risks = F.filter(F.transform(F.transform(F.split(text, RISK_START), piece("1a", "item1a")),
                                 lambda p: p.withField("number", p["number"] + shift)), long_enough)
    paragraphs = F.filter(F.transform(F.split(F.coalesce(F.col("item1"), F.lit("")), "\n\n"), tx.strip),
                          lambda p: F.length(p) >= MIN_CHUNK_CHARS)
    pieces = F.concat(risks, F.transform(paragraphs, piece("1", "item1")))
    url = "https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK="
    return (base.select("cik", "company", "sic", "period", F.posexplode(pieces).alias("sequence", "p"))
            .select(F.concat_ws("_", "cik", "period", "p.item", F.format_string("%04d", F.col("p.number")))
                    .alias("chunk_id"),
                    F.concat_ws("_", "cik", "period").alias("document_id"), "sequence",
                    F.col("p.source").alias("section_title"), F.col("p.text").alias("content"),
                    F.greatest(F.lit(1), tx.word_count(F.col("p.text"))).alias("token_estimate"),
                    F.col("company").alias("title"), F.concat(F.lit(url), "cik").alias("url"),
                    tx.industry_domain(F.col("sic")).alias("domain"), "cik", "period"))
