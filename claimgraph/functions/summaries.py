"""Short texts built from assertion columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scope_summary(with_organisation: bool = True, season_first: bool = True) -> Column:
    """``universal``, or the limits of an assertion's scope separated by commas."""
    season = F.when(~F.col("temporal_is_default"), F.concat(F.lit("season="), F.coalesce("temporal_season", F.lit("None"))))
    countries = F.when(~F.col("geo_is_global"),
                       F.concat(F.lit("countries=["), F.array_join("geo_countries", ", "), F.lit("]")))
    parts = [season, countries] if season_first else [countries, season]
    if with_organisation:
        parts.append(F.when(~F.col("org_is_universal"), "org-scoped"))
    text = F.concat_ws(", ", *parts)
    return F.when(text == "", "universal").otherwise(text)


def assertion_listing() -> Column:
    """One block of the assertion list that a relation extractor reads."""
    return F.concat(F.lit("ID: "), F.col("assertion_id").cast("string"), F.lit("\nClaim: "), F.col("claim_text"),
                    F.lit("\nScope: "), scope_summary(with_organisation=False, season_first=False), F.lit("\n"))


def two_digits(value: Column) -> Column:
    """Two decimals, halves rounded up."""
    return F.format_string("%.2f", value)


def evidence_line() -> Column:
    return F.concat(F.lit("["), F.upper("epistemic_status"), F.lit("] [toulmin_expansion] "), F.col("claim_text"),
                    F.lit(" (source: "), F.col("source_document"), F.lit(", conf: "),
                    two_digits(F.col("confidence")), F.lit(")"))


def trace_line() -> Column:
    return F.concat(F.lit("  ["), F.col("hops").cast("string"), F.lit(" hops, conf:"),
                    two_digits(F.col("chain_confidence")), F.lit("] [toulmin_expansion] via "),
                    F.coalesce("relation_used", F.lit("direct")), F.lit(": "), F.substring("claim_text", 1, 120))


def join_lines(rows: DataFrame, keys: list[str], position: str, line: Column, name: str,
               separator: str = "\n") -> DataFrame:
    """Text per key from rows already cut to a bounded number per key."""
    return (rows.groupBy(*keys)
            .agg(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), line.alias("t")))).alias("ls"))
            .select(*keys, F.array_join(F.transform("ls", lambda l: l["t"]), separator).alias(name)))


# The layers of a regulation's context in order, with their headings.
CONTEXT_LAYERS = [("warrant", "Warrant layer (authoritative source):"), ("ground", "Ground layer (peripheral documents):"),
                  ("backing", "Backing layer (institutional authority):")]


def regulation_line() -> Column:
    return F.concat(F.lit("    ["), F.upper("discourse_role"), F.lit("] [regulation_anchor] "), F.col("claim_text"), F.lit(" (source: "),
                    F.col("source_document"), F.lit(", conf: "), two_digits(F.col("confidence")), F.lit(")"))


def regulation_block(context: DataFrame) -> DataFrame:
    """(query_id, regulation, context_block): the layers of ``evidence.regulation_context`` as one text per query.

    Layers stand in the order warrant, ground, backing and an empty one is left out.  A layer holds a
    bounded number of rows (five there), so a text is made of at most three times as many.
    """
    names = F.array(*[F.lit(name) for name, _ in CONTEXT_LAYERS])
    heading = F.get(F.array(*[F.lit(text) for _, text in CONTEXT_LAYERS]), F.array_position(names, F.col("layer")).cast("int") - 1)
    layers = join_lines(context, ["query_id", "regulation", "layer"], "position", regulation_line(), "lines")
    text = F.concat(F.lit("  "), heading, F.lit("\n"), F.col("lines"))
    body = join_lines(layers.withColumn("place", F.array_position(names, F.col("layer"))), ["query_id", "regulation"], "place", text, "body")
    documents = context.groupBy("query_id", "regulation").agg(F.array_join(F.array_sort(F.collect_set("source_document")), ", ").alias("documents"))
    return body.join(documents, ["query_id", "regulation"]).select("query_id", "regulation", F.concat(
        F.lit("Cross-document regulation-anchored context [regulation_anchor]:\nCross-document context anchored on ["), F.col("regulation"),
        F.lit("] (contributing docs: "), F.col("documents"), F.lit("):\n"), F.col("body")).alias("context_block"))
