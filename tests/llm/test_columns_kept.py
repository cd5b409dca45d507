"""A filter gives back the user's columns as they were, also under names that it uses itself."""

import pytest
from odd_rows import rows_of
from pyspark.sql import functions as F

from claimgraph.llm import decontaminate, language, quality, simhash

HELPERS = {
    "keep_good": (quality.keep_good, ["_t", "_w", "_l", "_chars", "_symbols", "_ch", "_wh", "_h", "_n", "_repeat", "_dup_lines", "_failed",
                                      "_rc", "_rw", "_rs", "_char_distance", "_word_distance", "_few_common", "_kept", "_number"]),
    "keep_one": (simhash.keep_one, ["fp", "_fp", "rank", "_rank", "root", "component_id", "_component"]),
    "keep_identified": (language.keep_identified, ["a", "b", "score", "_score", "lang_pred", "_lang_pred", "held_out"]),
    "drop_contaminated": (None, ["key", "_key", "row", "w", "n_hit", "items"]),
}


@pytest.fixture(scope="module")
def good(spark):
    """Ordinary texts, an exact copy, a row without an id and a text that quotes an item."""
    def text(k):
        return " ".join(("the of and to in a is that it for".split())[(j + k) % 10] if j % 3 == 0 else f"w{chr(97 + j % 17)}rd{chr(97 + k)}{chr(97 + j * 7 % 19)}"
                        for j in range(40))
    rows = [(k, text(k), "en") for k in range(8)] + [(20, text(0), "en"), (None, text(9), "en"), (30, "alpha beta gamma delta " * 6, "en")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


@pytest.mark.parametrize("name", HELPERS)
def test_columns_pass_unchanged(spark, good, name):
    keep, helpers = HELPERS[name]
    if keep is None:
        items = spark.createDataFrame([("i", "alpha beta gamma delta alpha beta gamma delta alpha beta gamma")], "item_id string, text string")
        keep = lambda docs: decontaminate.drop_contaminated(docs, items)
    wide = good.select("*", *[(F.coalesce("doc_id", F.lit(-1)).cast("int") * 100 + k).alias(h) for k, h in enumerate(helpers)])
    out = keep(wide)
    assert out.schema.names == wide.schema.names and out.schema["text"].dataType == wide.schema["text"].dataType
    got = rows_of(out)
    assert got and set(got) <= set(rows_of(wide))
    assert rows_of(out.select("doc_id", "text", "lang")) == rows_of(keep(good))


def test_copies_without_an_id_are_one_group(spark):
    words = [f"w{k}" for k in range(400)]
    text = " ".join(words)
    nears = [" ".join([*words[:-k], *(f"v{j}" for j in range(k))]) for k in range(1, 60)]
    apart = [(simhash.fingerprint(text) ^ simhash.fingerprint(n)) & (1 << 64) - 1 for n in nears]
    near = next(n for n, x in zip(nears, apart, strict=True) if 1 <= x.bit_count() <= simhash.RADIUS)
    docs = spark.createDataFrame([(None, text), (None, near), (None, "another text altogether with words of its own")], "doc_id bigint, text string")
    assert simhash.keep_one(docs).count() == 2
