import hashlib
import random
import re

import duckdb
import pytest
from odd_rows import TEXTS, rows_of

from claimgraph.llm import decontaminate as D

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items):
    windows = []
    for item, text in items:
        w = words(text)
        if w:
            windows += [(item, w[i:i + 10]) for i in range(max(1, len(w) - 9))]
    out = []
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for item, window in windows:
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def corpus():
    draw = random.Random(4)
    pool = [f"w{k}" for k in range(12)] + ["Éa", "the", "of"]
    items = [(k, " ".join(draw.choice(pool) for _ in range(n))) for k, n in enumerate((14, 10, 9, 3, 1, 30))]
    items[4] = (4, "rareword")
    items += [(11, items[0][1]), (2, items[1][1]), (12, None), (13, "... !!!"), (None, items[2][1])]
    docs = [(k, " ".join(draw.choice(pool) for _ in range(60))) for k in range(20)]
    for k, (_, text) in enumerate(items[:6]):
        at = draw.randrange(40)
        w = docs[k][1].split()
        docs[k] = (k, ", ".join(w[:at] + text.upper().replace("É", "É").split() * 2 + w[at:]))
    return docs + [(1, docs[1][1]), (90, items[0][1]), (None, items[5][1])], items


@pytest.fixture(scope="module")
def tables(spark):
    docs, items = corpus()
    return docs, items, spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3), spark.createDataFrame(
        items, "item_id bigint, text string")


def test_brute_force(tables):
    docs, items, d, i = tables
    want = brute(docs, items)
    assert any(row[5] for row in want) and not all(row[5] for row in want)
    assert rows_of(D.report(d, i)) == want


def test_many_blocks_give_the_same(tables):
    docs, items, d, i = tables
    got = D.contamination(d, i, block_bytes=60).selectExpr("doc_id", "n_words", "n_hit", "size(items)")
    assert rows_of(got) == sorted((r[:4] for r in brute(docs, items)), key=repr)


def test_sql(tables):
    docs, items, d, i = tables
    con = duckdb.connect()
    con.register("documents", d.toPandas().astype({"doc_id": "Int64"}))
    con.register("benchmark", i.toPandas().astype({"item_id": "Int64"}))
    got = con.execute(f"select doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ({D.REPORT_SQL})").fetchall()
    assert sorted(got, key=repr) == brute(docs, items)


def test_plan_has_no_python_and_one_word_windows_match(tables):
    _, _, d, i = tables
    plan = D.report(d, i)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_odd_rows(odd_docs, no_docs, tables):
    _, items, _, i = tables
    want = brute([*TEXTS.items(), (9, "one"), (None, "no id here at all")], items)
    assert rows_of(D.report(odd_docs, i)) == want
    assert rows_of(D.report(no_docs, i)) == []
    assert not any(r["contaminated"] for r in D.report(odd_docs, i.where("item_id = -1")).collect())
    kept = D.drop_contaminated(odd_docs, i)
    assert kept.columns == odd_docs.columns and kept.count() == sum(not r[5] for r in want)
