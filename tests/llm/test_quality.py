import math
import random
import re
from collections import Counter

import pytest
from odd_rows import TEXTS, rows_of

from claimgraph.llm import quality as Q


def base(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times, hit = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 20 or 100 * len(hit) > 30 * n
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), failed)


def histograms(text, lang):
    import regex

    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0D]+", text) if w]
    letters, capitals, digits = (len(regex.findall(p, text)) for p in (r"\p{L}", r"\p{Lu}", r"\p{N}"))
    symbols, space = sum(c in "#*$%&|<>" for c in text), len(text) - sum(map(len, words))
    chars = [letters - capitals, capitals, digits, symbols, space, len(text) - letters - digits - symbols - space]
    common = [words.count(w) for w in Q.COMMON_WORDS.get(lang, ())]
    return chars, common + [len(words) - sum(common)]


def distance(a, b):
    if not sum(a) or not sum(b):
        return 0.0
    p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
    return math.sqrt(max(0.0, sum((x * math.log2(2 * x / (x + y)) if x else 0) + (y * math.log2(2 * y / (x + y)) if y else 0)
                                  for x, y in zip(p, q, strict=True)) / 2))


def share(words):
    return 1 - words[-1] / sum(words) if sum(words) else 0.0


def brute(docs):
    """docs: (doc_id, text, lang)."""
    groups, shares = {}, {}
    for _, text, lang in docs:
        group = lang if lang in Q.COMMON_WORDS else "other"
        groups.setdefault(group, []).append(histograms(text, lang))
        if not base(text)[5]:
            shares.setdefault(group, []).append(math.floor(share(groups[group][-1][1]) * Q.SHARE_UNITS + 0.5))
    floors = {g: Q.LEAST_COMMON * sum(s) / len(s) / Q.SHARE_UNITS for g, s in shares.items()}
    refs = {g: [[sum(x) for x in zip(*(h[k] for h in hs), strict=True)] for k in (0, 1)] for g, hs in groups.items()}
    out = []
    for doc_id, text, lang in docs:
        b = base(text)
        chars, words = histograms(text, lang)
        group = lang if lang in Q.COMMON_WORDS else "other"
        ref = refs[group]
        kept = (not b[5] and (b[1] < Q.MIN_CHARS or distance(chars, ref[0]) <= Q.MAX_CHAR_DISTANCE)
                and (b[0] < Q.MIN_COMMON_WORDS or distance(words, ref[1]) <= Q.MAX_WORD_DISTANCE and share(words) >= floors.get(group, 0.0)))
        out.append((doc_id, *b, kept))
    return sorted(out, key=repr)


def prose(draw, lang, n):
    return " ".join(draw.choice(Q.COMMON_WORDS.get(lang, Q.COMMON_WORDS["en"])) if draw.random() < 0.4 else
                    "".join(draw.choice("abcdeorst") for _ in range(draw.randrange(2, 9))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def docs():
    draw = random.Random(8)
    out = [(k, prose(draw, lang, draw.randrange(10, 300)), lang) for k, lang in enumerate(["en", "de", "fr", "es", "xx", None] * 12)]
    for k in range(0, 12):
        text = out[k][1]
        out.append((100 + k, re.sub(" ", "*** ", text), out[k][2]))
        out.append((200 + k, text.upper(), out[k][2]))
        out.append((300 + k, "\n".join([text] * (1 + k % 3)), out[k][2]))
        out.append((400 + k, text + " " + " ".join(text.split()[:k + 6]), out[k][2]))
    return out


def test_brute_force(spark, docs):
    want = brute(docs)
    assert len({row[-1] for row in want if not row[-2]}) == 2
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(3)
    assert rows_of(Q.report(df)) == want
    plan = Q.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_odd_rows(odd_docs, no_docs):
    rows = [(k, t, None if k % 3 else "en") for k, t in TEXTS.items()] + [(9, "one", "en"), (None, "no id here at all", None)]
    want = brute(rows)
    assert rows_of(Q.report(odd_docs)) == want
    assert rows_of(Q.report(no_docs)) == []
    kept = Q.keep_good(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == sum(r[-1] for r in want)


def test_the_filter_stays_above_its_projections(odd_docs):
    """Moved below, it would split the text anew for every window of a lambda."""
    plan = Q.keep_good(odd_docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") <= 2


def test_a_third_of_junk_does_not_hide_itself(spark):
    """Long texts without common words pull the reference towards them; they fail all the same."""
    draw = random.Random(5)

    def text(n, common):
        return " ".join(draw.choice(Q.COMMON_WORDS["en"]) if draw.random() < common else
                        "".join(draw.choice("abcdeorst") for _ in range(draw.randrange(2, 9))) + "q" for _ in range(n))

    rows = [(k, text(150, 0.18), "en") for k in range(60)] + [(100 + k, text(300, 0.0), "en") for k in range(30)]
    kept = {r["doc_id"] for r in Q.report(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).where("kept").collect()}
    assert kept == set(range(60))
