"""Text expressions on Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the line ends.
WHITE_SPACE = (" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680"
               "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
               "\u2028\u2029\u202f\u205f\u3000")
# The same characters as a pattern; ranges keep the test of an ordinary letter short.
WHITE_SPACE_CLASS = "[ \\t\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028-\\u2029\\u202f\\u205f\\u3000]"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"

# Section titles that hold no prose.
SKIPPED_SECTIONS = ["see also", "references", "external links", "further reading", "notes",
                    "bibliography", "footnotes", "citations", "sources", "works cited",
                    "related articles", "navigation menu"]

# Fixed value: words that negate a claim.
NEGATION = r"(?iU)\b(not|no|prohibit\w*|forbid\w*)\b"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, also inside array lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WHITE_SPACE_CLASS + "+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def lines(text: Column) -> Column:
    """Lines without their ends; a line end that closes the text opens no empty line."""
    return F.split(F.regexp_replace(text, f"(?:{LINE_END})\\z", ""), LINE_END)


def is_skipped_section(title: Column) -> Column:
    return F.lower(strip(title)).isin(SKIPPED_SECTIONS)


def is_label_list(text: Column) -> Column:
    """True for a list of short terms rather than prose."""
    counts = F.filter(F.transform(lines(strip(text)), word_count), lambda n: n > 0)

    def decide(ns: Column) -> Column:
        total = F.aggregate(ns, F.lit(0), lambda s, n: s + n)
        short = F.size(F.filter(ns, lambda n: n <= 4))
        return (F.when(F.size(ns) == 0, True)
                .when(F.size(ns) < 3, total <= 4)
                .otherwise(short / F.size(ns) > 0.6))

    return let(counts, decide)


def is_negated(text: Column) -> Column:
    return text.rlike(NEGATION)


def any_keyword(text: Column, keywords: list[str]) -> Column:
    """True where ``text`` holds one of the literal keywords."""
    found = F.lit(False)
    for word in keywords:
        found = found | F.contains(text, F.lit(word))
    return found


def first_matching(text: Column, groups: list[tuple[str, list[str]]], default: str) -> Column:
    """Name of the first group with a keyword in ``text``."""
    out = None
    for name, keywords in groups:
        hit = any_keyword(text, keywords)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


# Ordered keyword groups.
TITLE_DOMAINS = [
    ("banking", ["capital", "basel", "tier", "liquidity", "risk-weighted"]),
    ("securities", ["sec", "securities", "mifid", "fund", "etf"]),
    ("insurance", ["insurance", "solvency"]),
    ("derivatives", ["swap", "derivative", "option", "futures"]),
    ("regulatory", ["gdpr", "aml", "kyc", "fatca", "pci", "swift"]),
    ("accounting", ["ifrs", "gaap", "accounting", "fair value"]),
]
_RISK_WORDS = ["risk", "var", "stress", "concentration", "operational", "liquidity", "credit", "market"]
_THEORY_WORDS = ["capm", "apt", "black", "scholes", "arbitrage", "portfolio", "sharpe", "markowitz"]
_PRODUCT_WORDS = ["fund", "swap", "derivative", "option", "futures", "bond", "equity", "etf", "hedge"]
MAP_CATEGORIES = [
    ("regulatory", ["basel", "aifmd", "dodd", "mifid", "gdpr", "sox", "sarbanes", "volcker", "fatca",
                    "ifrs", "directive", " act", "regulation"]),
    ("risk", _RISK_WORDS), ("financial_theory", _THEORY_WORDS), ("products", _PRODUCT_WORDS),
]
CONFLICT_DOMAINS = [
    ("regulatory", ["basel", "aifmd", "dodd", "mifid", "gdpr", "sox", "sarbanes", "volcker", "ifrs",
                    "directive", "regulation", "act"]),
    ("risk", _RISK_WORDS), ("financial_theory", _THEORY_WORDS), ("products", _PRODUCT_WORDS),
]
QUERY_CATEGORIES = [
    ("regulatory", ["basel", "dodd", "mifid", "aifmd", "sarbanes", "gdpr", "volcker", "regulation",
                    "directive", "compliance", "supervisory"]),
    ("risk", ["risk", "var", "stress", "volatility", "exposure", "concentration", "liquidity",
              "credit risk", "operational risk"]),
    ("pricing", ["capm", "apt", "black-scholes", "arbitrage", "valuation", "pricing",
                 "expected return", "beta", "factor model"]),
    ("product", ["derivative", "swap", "option", "futures", "bond", "security", "collateral", "cdo",
                 "mortgage"]),
]


def title_domain(title: Column) -> Column:
    return first_matching(F.lower(title), TITLE_DOMAINS, "finance")


def map_category(name: Column) -> Column:
    return first_matching(F.lower(name), MAP_CATEGORIES, "other")


def conflict_domain(name: Column) -> Column:
    return first_matching(F.lower(F.coalesce(name, F.lit(""))), CONFLICT_DOMAINS, "other")


def query_category(title: Column) -> Column:
    return first_matching(F.lower(title), QUERY_CATEGORIES, "product")


def industry_domain(sic: Column) -> Column:
    """Domain of an industry code; text that is no number counts as 0."""
    code = F.when(sic.rlike(r"^[0-9]+$"), sic.try_cast("bigint")).otherwise(F.lit(0))
    return (F.when(code.between(6020, 6099) | code.between(6141, 6159), "banking")
            .when(code.between(6200, 6211), "securities")
            .when(code.between(6311, 6411), "insurance")
            .otherwise("finance"))


def period_key(period: Column) -> Column:
    return F.substring(F.replace(period, F.lit("-"), F.lit("")), 1, 6)


def confidence_bucket(confidence: Column) -> Column:
    return (F.when(confidence.isNull(), "unknown").when(confidence >= 0.90, "0.90_1.00")
            .when(confidence >= 0.80, "0.80_0.89").when(confidence >= 0.70, "0.70_0.79")
            .otherwise("below_0.70"))


def effect_label(d: Column) -> Column:
    size = F.abs(d)
    return (F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium")
            .otherwise("large"))


def llm_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / 4)


def embedding_tokens(text: Column) -> Column:
    return word_count(text) * 5
