"""Rule annotators: discourse roles, validity types and regulation mentions."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Cue words of each discourse role, strongest role first.
ROLE_CUES = [
    ("rebuttal", ["unless", "except", "except when", "provided that", "does not apply when"]),
    ("backing", ["per §", "per section", "under section", "pursuant to", "in accordance with"]),
    ("warrant", ["must", "shall", "required to", "prohibited from"]),
    ("qualifier", ["under normal conditions", "as applicable", "where required", "in most cases",
                   "generally"]),
]
# Cue words of each validity type.
VALIDITY_CUES = [
    ("normative", ["must", "shall", "required", "prohibited", "permitted"]),
    ("expressive", ["designed to", "intended to", "the purpose of", "purpose of this policy"]),
]

# Regulations, agencies and standards by name.
REGULATION_NAMES = [
    "Basel III", "Basel II", "Basel I", "Basel IV", "CRR", "CRD IV", "FRTB",
    "Dodd-Frank", "Dodd-Frank Wall Street Reform and Consumer Protection Act", "Volcker Rule",
    "Sarbanes-Oxley", "Sarbanes-Oxley Act", "SOX", "Bank Secrecy Act", "BSA",
    "Community Reinvestment Act", "CRA", "Glass-Steagall", "Glass-Steagall Act",
    "Consumer Financial Protection Bureau", "CFPB", "Office of the Comptroller of the Currency", "OCC",
    "Federal Reserve", "Federal Deposit Insurance Corporation", "FDIC",
    "Securities and Exchange Commission", "SEC", "Commodity Futures Trading Commission", "CFTC",
    "Financial Industry Regulatory Authority", "FINRA", "Office of Foreign Assets Control", "OFAC",
    "Financial Crimes Enforcement Network", "FinCEN",
    "DFAST", "CCAR", "CECL",
    "Anti-Money Laundering", "AML", "Know Your Customer", "KYC", "Customer Due Diligence", "CDD",
    "USA PATRIOT Act", "FATF", "Financial Action Task Force",
    "MiFID", "MiFID II", "Markets in Financial Instruments Directive", "EMIR", "AIFMD",
    "Alternative Investment Fund Managers Directive", "UCITS", "Securities Act of 1933",
    "Securities Exchange Act of 1934", "Investment Advisers Act", "Investment Company Act",
    "Foreign Account Tax Compliance Act", "FATCA",
    "Solvency II", "Solvency II Directive", "IAIS", "NAIC",
    "BCBS", "FSB", "Financial Stability Board", "IOSCO", "CPMI", "International Monetary Fund", "IMF",
    "IFRS", "International Financial Reporting Standards", "GAAP",
    "Generally Accepted Accounting Principles",
    "PCI DSS", "Payment Card Industry Data Security Standard", "SWIFT",
    "Society for Worldwide Interbank Financial Telecommunication", "GDPR",
    "General Data Protection Regulation", "CCPA", "PSD2",
    "LCR", "NSFR", "VaR", "LIBOR", "SOFR",
]


def _cue_pattern(cues: list[str]) -> str:
    return r"(?iU)\b(" + "|".join(cues) + r")\b"


def discourse_role(text: Column) -> Column:
    out = None
    for role, cues in ROLE_CUES:
        hit = text.rlike(_cue_pattern(cues))
        out = F.when(hit, role) if out is None else out.when(hit, role)
    return out.otherwise("ground")


def validity_type(text: Column) -> Column:
    out = None
    for kind, cues in VALIDITY_CUES:
        hit = text.rlike(_cue_pattern(cues))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("constative")


# Names up to this number are one pattern inside the plan; larger gazetteers are joined.
PATTERN_NAMES = 5_000
_WORD = r"[\p{L}\p{N}_]"


def _branch(node: dict) -> str:
    """The pattern of a prefix tree of characters; the longest way through it is tried first."""
    ways = [(char if char.isalnum() or char == " " else "\\" + char) + _branch(child) for char, child in sorted(node.items()) if char]
    if not ways:
        return ""
    if "" in node:
        return "(?:" + "|".join(ways) + ")?"
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


def name_mentions(text: Column, names: list[str], keys: list[str] | None = None) -> Column:
    """Names that occur in ``text`` as whole words, any case, once each and in the order of ``names``.

    One pass per text: a pattern made of the prefix tree of all names finds the longest one at
    every place, and any other name that occurs there begins it, which a constant map
    answers.  ``keys`` are the names in lower case, if they are known.  A null text has
    null; a name without a letter or digit is never found.
    """
    by_key: dict[str, list[str]] = {}
    for name, key in zip(names, keys or [n.lower() for n in names], strict=True):
        if re.search(r"\w", key) and name not in by_key.setdefault(key, []):
            by_key[key].append(name)
    tree: dict = {}
    for key in by_key:
        node = tree
        for char in key:
            node = node.setdefault(char, {})
        node[""] = {}
    if not tree:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    # The names that a text has wherever it has the key as the longest one.
    here = {key: [n for end in range(1, len(key) + 1) if end == len(key) or not re.match(r"\w", key[end])
                  for n in by_key.get(key[:end], [])] for key in by_key}
    longest = f"(?<!{_WORD})(?=({_branch(tree)})(?!{_WORD}))"
    hits = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(longest), F.lit(1)))
    held = F.from_json(F.lit(json.dumps(here)), "map<string,array<string>>")
    found = F.flatten(F.transform(hits, lambda key: F.element_at(held, key)))
    return F.array_intersect(F.from_json(F.lit(json.dumps(list(names))), "array<string>"), found)


def table_mentions(texts: DataFrame, gazetteer: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """(id, name): names of a gazetteer table (name) that occur in a text as whole words, any case, once each.

    A table of at most PATTERN_NAMES names, counted first, becomes one pattern in the scan, and
    no text is shuffled.  In a larger one digests of texts meet the names on their first
    words, and each distinct text is shuffled once to its candidates, however many they are.
    A name without a letter or digit has no word and is never found.
    """
    names = (gazetteer.select("name", F.lower("name").alias("key")).where("name is not null").distinct()
             .withColumn("first", F.regexp_extract("key", f"({_WORD}+)", 1)).where("first <> ''"))
    known = names.select("name", "key").limit(PATTERN_NAMES + 1).collect()
    rows = texts.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    if len(known) <= PATTERN_NAMES:
        known.sort()
        hit = name_mentions(F.col("text"), [r["name"] for r in known], [r["key"] for r in known])
        found = rows.select("id", F.explode(hit).alias("name"))
    else:
        found = _joined_mentions(rows, names)
    return found.select(F.col("id").alias(id_column), "name").distinct()


def _joined_mentions(rows: DataFrame, names: DataFrame) -> DataFrame:
    low = rows.select("id", F.lower("text").alias("low")).withColumn("digest", F.md5("low"))
    words = low.select("digest", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(f"({_WORD}+)"), 1))).alias("first"))
    candidates = words.join(names, "first").select("digest", "name", "key").distinct()
    once = low.groupBy("digest").agg(F.any_value("low").alias("low"))
    pattern = F.concat(F.lit(f"(?<!{_WORD})"), F.regexp_replace("key", r"([^\p{L}\p{N}_ ])", r"\\$1"), F.lit(f"(?!{_WORD})"))
    found = (candidates.join(once, "digest").where(F.contains("low", "key") & F.rlike("low", pattern)).select("digest", "name"))
    return low.select("id", "digest").join(found, "digest").select("id", "name")


def regulation_mentions(text: Column, names: list[str] | None = None) -> Column:
    """Regulation names that occur in ``text`` as whole words, any case; one pass inside the scan stage."""
    return name_mentions(text, REGULATION_NAMES if names is None else names)
