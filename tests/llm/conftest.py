"""Shared rows for the tests of this folder."""

import pytest
from odd_rows import TEXTS


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows and columns with clashing names."""
    rows = [(k, t, None if k % 3 else "en", "s", k, "clash", 1, -1) for k, t in TEXTS.items()]
    rows += [(9, "one", "en", "s", 9, "clash", 1, -1), (None, "no id here at all", None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, "
                                       "words string, fp int, `row` int").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("doc_id = -1")
