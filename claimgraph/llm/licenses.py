"""Licence scans by sentence rules (operator 4).

A text is cut into sentences; each normalised sentence that is known maps to its
identifier, and the text becomes the sequence of identifiers in its order.  Rules are
ordered identifier sequences; a rule holds where its sequence stands in that of the
text without another known sentence between.

Sentences end at a mark and white space, and at line ends.  Licences are often wrapped,
so the text is also read with only blank lines as line ends.  The reading that knows more
sentences is reported; the rules that hold in either count.

Built-in functions only, all inside the document's own row: no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import ascii_lower, let

# Sentences of published licences and notices, and the sequences that stand for a licence.
SENTENCES: dict[str, str] = {
    "mit_notice": "Released under the MIT License",
    "mit_notice_2": "This project is licensed under the MIT License",
    "mit_title": "The MIT License (MIT)",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                 "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
                 "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
                 "permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions "
                     "of the Software",
    "as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
             "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "apache_notice": "Licensed under the Apache License, Version 2.0",
    "apache_header": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_use": "you may not use this file except in compliance with the License",
    "apache_copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache_copy_tls": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0",
    "apache_copy_at": "You may obtain a copy of the License at",
    "apache_url": "http://www.apache.org/licenses/LICENSE-2.0",
    "apache_url_tls": "https://www.apache.org/licenses/LICENSE-2.0",
    "apache_copy_on": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable "
                      "law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                      "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_copy_on_tls": "You may obtain a copy of the License at https://www.apache.org/licenses/LICENSE-2.0 Unless required by "
                          "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
                          "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "gpl3_notice": "This work is licensed under the GNU General Public License, version 3",
    "gpl_free": "This program is free software",
    "gpl2_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl3_later": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
                  "Software Foundation",
    "gpl2_version": "either version 2 of the License, or (at your option) any later version",
    "gpl3_version": "either version 3 of the License, or (at your option) any later version",
    "bsd_head": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
                "following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
                  "disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
                  "disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                 "derived from this software without specific prior written permission",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc_by": "Licensed under CC BY 4.0",
    "cc_by_sa": "Licensed under CC BY-SA 4.0",
    "reserved": "All rights reserved",
}
RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("mit_notice",)), ("MIT", ("mit_notice_2",)), ("MIT", ("mit_grant", "mit_condition", "as_is")),
    ("MIT-incomplete", ("mit_grant", "as_is")),
    ("Apache-2.0", ("apache_notice",)), ("Apache-2.0", ("apache_header", "apache_use", "apache_copy")),
    *[("Apache-2.0", ("apache_header", "apache_use", *copy)) for copy in (
        ("apache_copy_tls",), ("apache_copy_at", "apache_url"), ("apache_copy_at", "apache_url_tls"), ("apache_copy_on",), ("apache_copy_on_tls",))],
    ("GPL-3.0", ("gpl3_notice",)), ("GPL-3.0-or-later", ("gpl_free", "gpl2_terms", "gpl3_version")), ("GPL-3.0-or-later", ("gpl_free", "gpl3_later")),
    ("GPL-2.0-or-later", ("gpl_free", "gpl2_later")), ("GPL-2.0-or-later", ("gpl_free", "gpl2_terms", "gpl2_version")),
    ("BSD-2-Clause", ("bsd_head", "bsd_source", "bsd_binary")),
    ("BSD-3-Clause", ("bsd_head", "bsd_source", "bsd_binary", "bsd_names")),
    ("CC-BY-NC-4.0", ("cc_by_nc",)), ("CC-BY-4.0", ("cc_by",)), ("CC-BY-SA-4.0", ("cc_by_sa",)),
    ("Proprietary", ("reserved",)),
)
# A longer rule that holds replaces the shorter one that it begins with.
REPLACES = {"BSD-3-Clause": "BSD-2-Clause"}
MARKS, OTHER = r"([.!?:;])[ \t\r\n]+", r"[^a-z0-9]+"


def normalised(sentence: str) -> str:
    kept = "".join(c if c.isascii() and c.isalnum() else " " for c in sentence).lower()
    return " ".join(kept.split())


def known(text: Column, line_end: str) -> Column:
    """Identifiers of the known sentences of ``text`` in order."""
    names = F.create_map(*[part for name, s in SENTENCES.items() for part in (F.lit(normalised(s)), F.lit(name))])
    sentences = F.split(F.regexp_replace(text, MARKS, "$1\n\n"), line_end)
    return let(names, lambda m: F.array_compact(F.transform(
        sentences, lambda s: m[F.trim(F.regexp_replace(s, OTHER, " "))])))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, sentences, licenses): the identifiers in order and the sorted names of the rules that hold, as arrays.

    A null or empty text has neither; repeated rows are scanned each; an empty table gives
    an empty one; other columns are not read.
    """
    rows = docs.select("doc_id", ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("t"))
    read = rows.select("doc_id", known(F.col("t"), r"\n+").alias("by_line"), known(F.col("t"), r"\n[ \t\r]*\n\s*").alias("by_block"))
    found = read.select("doc_id", "by_line", "by_block", F.when(F.size("by_block") > F.size("by_line"), F.col("by_block")).otherwise(F.col("by_line")).alias("sentences"))
    # No rule can begin in one reading and end in the other: an empty name stands between them.
    sequence = F.concat(F.lit(","), F.array_join("by_line", ","), F.lit(",,"), F.array_join("by_block", ","), F.lit(","))
    holds = F.array_compact(F.array(*[F.when(F.contains(F.col("sequence"), F.lit("," + ",".join(rule) + ",")), F.lit(name))
                                      for name, rule in RULES]))
    less = [F.when(F.array_contains("holds", more), F.lit(gone)) for more, gone in REPLACES.items()]
    return (found.withColumn("sequence", sequence).withColumn("holds", holds)
            .select("doc_id", "sentences", F.array_sort(F.array_except(F.array_distinct("holds"), F.array_compact(F.array(*less)))).alias("licenses")))


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_sentences, sentences, n_licenses, licenses) with the lists comma-joined."""
    return scan(docs).select("doc_id", F.size("sentences").cast("bigint").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"),
                             F.size("licenses").cast("bigint").alias("n_licenses"), F.array_join("licenses", ",").alias("licenses"))


def report_sql() -> str:
    """The same by joins of rows: one per sentence and one per rule."""
    names = ", ".join(f"('{normalised(s)}', '{name}')" for name, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', ',{','.join(rule)},')" for name, rule in RULES)
    less = ", ".join(f"('{more}', '{gone}')" for more, gone in REPLACES.items())
    return f"""
with names(s, name) as (values {names}), rules(license, rule) as (values {rules}), less(more, gone) as (values {less}),
d as (
    select row_number() over () as rid, doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '([.!?:;])[ \\t\\r\\n]+', '\\1' || chr(10) || chr(10), 'g') as t from documents),
ways(way, line_end) as (values (1, '\\n+'), (2, '\\n[ \\t\\r]*\\n\\s*')),
cut as (select rid, way, string_split_regex(t, line_end) as a from d, ways),
s as (select rid, way, unnest(range(1, len(a) + 1)) as k, unnest(a) as x from cut),
ids as (
    select rid, way, count(*) as n, string_agg(name, ',' order by k) as seq
    from s join names on trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) = s.s group by rid, way),
best as (select rid, n, seq from ids qualify row_number() over (partition by rid order by n desc, way) = 1),
held as (select distinct rid, license from best, rules where contains(',' || seq || ',', rule)),
kept as (
    select rid, count(*) as n, string_agg(license, ',' order by license) as l from held h
    where not exists (select 1 from held o join less on more = o.license where o.rid = h.rid and gone = h.license) group by rid)
select doc_id, cast(coalesce(best.n, 0) as bigint) as n_sentences, coalesce(seq, '') as sentences,
       cast(coalesce(kept.n, 0) as bigint) as n_licenses, coalesce(l, '') as licenses
from d left join best using (rid) left join kept using (rid)
""".replace("= s.s group", "= names.s group")
