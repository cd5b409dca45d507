from claimgraph.operators import curation as U

INDEX = "cik string, company string, sic string, filing_date string, accession_no string, period string"


def test_latest_filing_per_firm(spark):
    rows = [("123", "A", "6022", "2023-03-15", "2", "2022-12"), ("123", "A", "6022", "2022-03-15", "1", "2021-12"),
            ("456", "B", "6022", "2021-01-01", "3", "2020-12")]
    got = {r.cik: r.filing_date for r in U.latest_per_firm(spark.createDataFrame(rows, INDEX)).collect()}
    assert got == {"123": "2023-03-15", "456": "2021-01-01"}


def test_cap_and_empty_index(spark):
    rows = [(str(i), "F", "6022", "2023-01-01", str(i), "2022-12") for i in range(300)]
    assert U.newest_firms(spark.createDataFrame(rows, INDEX)).count() == 200
    assert U.newest_firms(spark.createDataFrame([], INDEX)).count() == 0


def test_scope_of_codes_and_years(spark):
    rows = [("1", "A", "6022", "2018-01-01", "1", "p"), ("2", "A", "6022", "2017-12-31", "2", "p"), ("3", "A", "7372", "2020-01-01", "3", "p")]
    assert [r.cik for r in U.in_scope_filings(spark.createDataFrame(rows, INDEX)).collect()] == ["1"]


def test_boilerplate_edges(spark):
    rows = [("few", "x" * 50, "y" * 50), ("no risk", "x" * 3000, ""), ("blank risk", "x" * 3000, "  \n"),
            ("enough", "x" * 1500, "y" * 1000), ("limit", "x" * 1000, "y" * 1000), ("below", "x" * 999, "y" * 1000)]
    df = U.with_char_count(spark.createDataFrame(rows, "cik string, item1 string, item1a string"))
    assert sorted(r.cik for r in U.drop_boilerplate(df).collect()) == ["enough", "limit"]
    counts = U.boilerplate_counts(df).first()
    assert (counts.kept, counts.dropped) == (2, 4)


def test_stratified_queries_fill(spark):
    pool = [(i, "normative", "risk") for i in range(40)] + [(100 + i, "normative", "pricing") for i in range(4)]
    got = U.stratified_queries(spark.createDataFrame(pool, "query_id long, epistemic_type string, source_category string"),
                               per_category=10, per_type=20).collect()
    ids = {r.query_id for r in got}
    assert len(ids) == 20 and {100, 101, 102, 103} <= ids and set(range(16)) <= ids
