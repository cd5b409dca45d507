import re

import duckdb
from odd_rows import TEXTS, rows_of

from claimgraph.llm import licenses as N


def brute(text):
    t = re.sub(r"([.!?:;])[ \t\r\n]+", r"\1\n\n", (text or "").translate(
        str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    names = {N.normalised(s): name for name, s in N.SENTENCES.items()}
    best = []
    for line_end in (r"\n+", r"\n[ \t\r]*\n[ \t\r\n\f\v]*"):
        ids = [names[k] for x in re.split(line_end, t) if (k := re.sub("[^a-z0-9]+", " ", x).strip()) in names]
        if len(ids) > len(best):
            best = ids
    sequence = f",{','.join(best)},"
    holds = {name for name, rule in N.RULES if f",{','.join(rule)}," in sequence}
    holds -= {gone for more, gone in N.REPLACES.items() if more in holds}
    return len(best), ",".join(best), len(holds), ",".join(sorted(holds))


def sentence(*names):
    return [N.SENTENCES[n] for n in names]


def cases():
    mit, bsd = sentence("mit_grant", "mit_condition", "as_is"), sentence("bsd_head", "bsd_source", "bsd_binary", "bsd_names")
    wrapped = "\n".join(re.sub(r"(.{40,60}) ", r"\1\n", s) for s in mit)
    return [". ".join(mit), ".\n\n".join(re.sub(r"(.{40,60}) ", r"\1\n", s) for s in mit), wrapped, "; ".join(mit[::-1]), ". ".join(bsd),
            ". ".join(bsd[:3]), "Words before.\nReleased under the MIT License.\nWords after.", "released UNDER the mit license",
            "Words Released under the MIT License.", "All rights reserved.\nLicensed under CC BY-NC 4.0.",
            ". ".join(sentence("gpl_free", "gpl2_terms", "gpl3_version")), "Licensed under the Apache License, Version 2.0."]


def test_rules(spark):
    docs = list(enumerate(cases()))
    want = sorted(((k, *brute(t)) for k, t in docs), key=repr)
    assert [w[4] for w in sorted(want)][:8] == ["MIT", "MIT", "", "", "BSD-3-Clause", "BSD-2-Clause", "MIT", "MIT"]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert rows_of(N.report(df)) == want
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    assert sorted(con.execute(N.report_sql()).fetchall(), key=repr) == want
    plan = N.report(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_rows(odd_docs, no_docs):
    docs = [*TEXTS.items(), (9, "one"), (None, "no id here at all")]
    assert rows_of(N.report(odd_docs)) == sorted(((k, *brute(t)) for k, t in docs), key=repr)
    assert rows_of(N.report(no_docs)) == []


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.
"""


def marked(text, mark):
    return "".join(f"{mark} {line}".rstrip() + "\n" for line in text.splitlines())


def test_published_notices(spark):
    mit = "\n".join(re.sub(r"(.{40,60}) ", r"\1\n", s) + ".\n" for s in sentence("mit_grant", "mit_condition", "as_is"))
    lines = "\n".join(s for s in sentence("bsd_head", "bsd_source", "bsd_binary", "bsd_names"))
    docs = [(APACHE, "Apache-2.0"), (marked(APACHE, "#"), "Apache-2.0"), (marked(APACHE, "//"), "Apache-2.0"),
            (APACHE.replace("http:", "https:"), "Apache-2.0"), (marked(APACHE.replace("http:", "https:"), " *"), "Apache-2.0"),
            (GPL3, "GPL-3.0-or-later"), (GPL3.replace("version 3", "version 2").replace("Foundation,", "Foundation;"), "GPL-2.0-or-later"),
            (lines + "\n\n" + mit, "BSD-3-Clause,MIT")]
    df = spark.createDataFrame([(k, text) for k, (text, _) in enumerate(docs)], "doc_id bigint, text string")
    assert [r["licenses"] for r in N.report(df).orderBy("doc_id").collect()] == [want for _, want in docs]
