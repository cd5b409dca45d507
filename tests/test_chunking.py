from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from claimgraph.functions import text as tx
from claimgraph.operators import chunking as K


def one(spark, value, expr, **more):
    row = spark.createDataFrame([(value,)], "t string").select(expr(F.col("t"), **more).alias("r")).first()
    return row.r


def windows(spark, text, size=400, overlap=50):
    return one(spark, text, K.windows, size=size, overlap=overlap)


def test_short_text_stays(spark):
    assert windows(spark, "one two  three four five") == ["one two  three four five"]


def test_empty_text_is_one_empty_chunk(spark):
    assert windows(spark, "") == [""]


def test_exactly_the_limit(spark):
    assert len(windows(spark, " ".join(["w"] * 400))) == 1


def test_long_text(spark):
    found = windows(spark, " ".join(["w"] * 600))
    assert len(found) >= 2 and all(len(c.split()) <= 400 for c in found)


def test_overlap(spark):
    found = windows(spark, " ".join(f"word{i}" for i in range(500)), 200, 50)
    assert found[0].split()[-50:] == found[1].split()[:50]


def test_sections(spark):
    text = "Intro line.\n\n== First ==\nBody one.\n=== Second ===\nBody two.\n== Empty ==\n\n"
    assert one(spark, text, K.sections) == ["Intro line.", "First\nBody one.", "Second\nBody two."]


def test_no_heading_is_the_whole_text(spark):
    assert one(spark, " plain text ", K.sections) == ["plain text"]
    assert one(spark, "  ", K.sections) == ["  "]


def test_preamble_loses_its_first_line_to_the_title(spark):
    row = one(spark, "First line\nSecond line", K.split_title)
    assert (row.title, row.body) == ("First line", "Second line")
    row = one(spark, "Only line", K.split_title)
    assert (row.title, row.body) == ("Only line", "Only line")


def test_label_lists(spark):
    cases = {"": True, "a b": True, "one two three four five": False, "a\nb c\nd e f": True,
             "a\nb\n" + "long line with many words\n" * 3: False}
    for text, want in cases.items():
        assert one(spark, text, tx.is_label_list) is want, text


def test_skipped_sections(spark):
    assert one(spark, "  See Also ", tx.is_skipped_section)
    assert not one(spark, "Overview", tx.is_skipped_section)


def test_articles_number_kept_chunks(spark):
    body = " ".join(["word"] * 200)
    text = f"== One ==\n{body}\n== References ==\n{body}\n== Short ==\nfew words here\n== Two ==\n{body}"
    rows = K.chunk_articles(spark.createDataFrame([("d", text)], "document_id string, content string")).orderBy("sequence").collect()
    assert [(r.sequence, r.section_title, r.token_estimate) for r in rows] == [(0, "One", 200), (1, "Two", 200)]
    assert len({r.chunk_id for r in rows}) == 2


def test_unicode_white_space(spark):
    assert one(spark, "a b c　d", tx.words) == ["a", "b", "c", "d"]
    assert one(spark, "  x  ", tx.strip) == "x"


def filings(spark, item1a, item1=""):
    return spark.createDataFrame([("1", "Firm", "6022", "2023-03", item1, item1a)],
                                 "cik string, company string, sic string, period string, item1 string, item1a string")


LONG = "Some risk text that is long enough. " * 8


def test_risk_factor_splits(spark):
    text = f"{LONG}\nMARKET AND CREDIT RISKS\n{LONG}\nRisk Factor 2\n{LONG}\n• Bullet {LONG}"
    rows = K.risk_factor_chunks(filings(spark, text)).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in rows] == [f"1_2023-03_1a_{i:04d}" for i in range(4)]
    assert rows[1].text.startswith("MARKET AND CREDIT RISKS")


def test_header_at_the_start_counts_an_empty_piece(spark):
    rows = K.risk_factor_chunks(filings(spark, f"\nMARKET AND CREDIT RISKS\n{LONG}")).collect()
    assert [r.chunk_id for r in rows] == ["1_2023-03_1a_0001"]


def test_dropped_risk_pieces_count_but_dropped_paragraphs_do_not(spark):
    risks = K.risk_factor_chunks(filings(spark, f"short\nRisk Factor 1\n{LONG}")).collect()
    assert [r.chunk_id for r in risks] == ["1_2023-03_1a_0001"]
    paragraphs = K.paragraph_chunks(filings(spark, "", f"short\n\n{LONG}\n\n{LONG}")).orderBy("chunk_id").collect()
    assert [r.chunk_id for r in paragraphs] == ["1_2023-03_1_0000", "1_2023-03_1_0001"]


def test_common_chunks_put_risks_first(spark):
    rows = K.common_chunks(filings(spark, LONG, LONG)).orderBy("sequence").collect()
    assert [(r.sequence, r.section_title, r.document_id, r.domain) for r in rows] == [
        (0, "item1a", "1_202303", "banking"), (1, "item1", "1_202303", "banking")]


def test_industry_domains(spark):
    codes = {"6022": "banking", "6035": "banking", "6099": "banking", "6141": "banking", "6200": "securities",
             "6211": "securities", "6311": "insurance", "6411": "insurance", "7372": "finance", "bank": "finance", "": "finance"}
    for code, want in codes.items():
        assert one(spark, code, tx.industry_domain) == want


@settings(max_examples=25, deadline=None)
@given(n=st.integers(0, 300), size=st.integers(5, 60), overlap=st.integers(0, 4))
def test_windows_cover_every_word_in_order(spark, n, size, overlap):
    words = [f"w{i}" for i in range(n)]
    found = [c.split() for c in windows(spark, " ".join(words), size, overlap)]
    merged = found[0] + [w for chunk in found[1:] for w in chunk[overlap:]]
    assert merged == words
