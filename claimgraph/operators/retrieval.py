"""Retrieval over chunks and assertions for a whole batch of queries.

``queries`` is (query_id, epistemic_type, vector).  Ranked results are
(query_id, rank, assertion_id, ...) with at most k rows per query.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.ranking import running, top_per_key
from claimgraph.operators import paths as P
from claimgraph.operators.assertions import live, positive_or
from claimgraph.operators.evidence import graph_contradictions, regulation_periphery
from claimgraph.operators.similarity import top_k
from claimgraph.session import cut_lineage, few

MAX_K = 50
WANTS = ["any", "normative", "constative"]
FIELDS = ["confidence", "validity_claim_type", "discourse_role", "source_document", "epistemic_status", "claim_text"]


# ---- base searches -----------------------------------------------------------------------------

def top_chunks(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, chunk_id, score)."""
    items = vectors.select(F.col("chunk_id").alias("item_id"), "vector", F.array("chunk_id").alias("ties"))
    found = top_k(queries.select("query_id", F.lit(0).alias("want"), "vector"), items, k)
    return found.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "score")


def top_chunks_of_domain(queries: DataFrame, vectors: DataFrame, domains: Sequence[str], k: int) -> DataFrame:
    """As ``top_chunks``, among chunks of the query's domain; both sides carry ``domain``."""
    number = F.array_position(F.array(*[F.lit(d) for d in domains]), F.col("domain")) - 1
    items = vectors.select(F.col("chunk_id").alias("item_id"), "vector", F.array(*[
        F.when(F.col("domain") == d, F.col("chunk_id")) for d in domains]).alias("ties"))
    found = top_k(queries.where(F.col("domain").isin(list(domains))).select("query_id", number.alias("want"), "vector"),
                  items, k)
    return found.select("query_id", "rank", F.col("item_id").alias("chunk_id"), "score")


def assertion_vectors(assertions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Assertions with the vector of their chunk; those without one are left out."""
    return (assertions.select("assertion_id", "document_id", "confidence", "validity_claim_type", "discourse_role", "chunk_id")
            .join(vectors.select("chunk_id", "vector"), "chunk_id"))


def assertions_without_vector(assertions: DataFrame, vectors: DataFrame) -> DataFrame:
    return assertions.join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("skipped"))


def _wanted(want: Column) -> Column:
    """Whether an assertion row qualifies for a want index."""
    return (want == 0) | (F.col("validity_claim_type") == F.get(F.array(*[F.lit(w) for w in WANTS]), want))


def top_assertions(requests: DataFrame, assertions: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query_id, want, rank, assertion_id, score) by similarity of the parent chunk.

    ``requests`` is (query_id, want, vector).  Siblings share a vector, so the
    search runs over chunks, ranked by their smallest qualifying assertion: the k
    best assertions always lie in the k best chunks.  A chunk hands on at most k
    assertions, however many it has.
    """
    ids = [F.min(F.when(_wanted(F.lit(i)), F.col("assertion_id"))) for i in range(len(WANTS))]
    firsts = assertions.groupBy("chunk_id").agg(F.array(*ids).alias("ties"))
    items = (vectors.select("chunk_id", "vector").join(firsts, "chunk_id")
             .select(F.col("chunk_id").alias("item_id"), "vector", "ties"))
    chunks = few(top_k(requests, items, k).select("query_id", "want", F.col("item_id").alias("chunk_id"), "score"))
    members = (assertions.select("chunk_id", "assertion_id", "validity_claim_type")
               .withColumn("want", F.explode(F.sequence(F.lit(0), F.lit(len(WANTS) - 1))))
               .where(_wanted(F.col("want")))
               .join(chunks.select("chunk_id", "want"), ["chunk_id", "want"], "left_semi"))
    members = top_per_key(members, ["chunk_id", "want"], [F.col("assertion_id")], k)
    return (top_per_key(chunks.join(members, ["chunk_id", "want"]), ["query_id", "want"],
                        [F.desc("score"), F.col("assertion_id")], k, rank="rank")
            .select("query_id", "want", "rank", "assertion_id", "score"))


def requests_for(queries: DataFrame) -> DataFrame:
    """Which searches a query needs: always the plain one, and those of its type."""
    kind = F.col("epistemic_type")
    wants = (F.when(kind == "normative", F.array(F.lit(0), F.lit(1)))
             .when(kind == "mixed", F.array(F.lit(0), F.lit(1), F.lit(2)))
             .otherwise(F.array(F.lit(0), F.lit(2))))
    return queries.select("query_id", F.explode(wants).alias("want"), "vector")


def search(queries: DataFrame, assertions: DataFrame, vectors: DataFrame, k: int = MAX_K) -> DataFrame:
    """All searches of a batch, stored once: every condition starts from these rows."""
    found = top_assertions(requests_for(queries), assertions, vectors, k)
    return cut_lineage(found.join(queries.select("query_id", "epistemic_type"), "query_id"))


# ---- fetching ----------------------------------------------------------------------------------

def fetch(rows: DataFrame, assertions: DataFrame) -> DataFrame:
    """Attach assertion fields; ids of dead assertions vanish."""
    fields = (assertions.where(live()).select("assertion_id", *FIELDS)
              .withColumn("confidence", positive_or(F.col("confidence")))
              .withColumn("validity_claim_type", F.coalesce("validity_claim_type", F.lit("unclassified")))
              .withColumn("discourse_role", F.coalesce("discourse_role", F.lit("unclassified"))))
    return few(rows).join(fields, "assertion_id")


def assertions_of_chunks(chunks: DataFrame, assertions: DataFrame) -> DataFrame:
    """Live assertions of a query's chunks; ``chunks`` is (query_id, chunk_id, ...)."""
    return fetch(few(chunks).join(assertions.select("chunk_id", "assertion_id"), "chunk_id"), assertions)


def ranked(rows: DataFrame, k: int | None = None) -> DataFrame:
    """Rank by confidence.  Without a limit the ranks are counted in two levels, as a query may match very many."""
    rows = rows.drop("rank")
    if k is not None:
        return top_per_key(rows, ["query_id"], by_confidence(), k, rank="rank")
    bucket = F.struct((-F.col("confidence")).alias("c"), F.floor(F.col("assertion_id") / 65_536).alias("i"))
    return running(rows, ["query_id"], by_confidence(), bucket, {"rank": F.lit(1)})


def by_confidence() -> list[Column]:
    return [F.desc("confidence"), F.col("assertion_id")]


def _as_seeds(rows: DataFrame, n: int) -> DataFrame:
    return rows.where(F.col("rank") <= n).select("query_id", F.col("assertion_id").alias("node"), "rank")


def _merge(base: DataFrame, *more: DataFrame) -> DataFrame:
    """``base`` and the rows of ``more`` whose assertion it lacks, each once."""
    keys = ["query_id", "assertion_id"]
    extra = None
    for rows in more:
        part = rows.select(*keys, *FIELDS)
        extra = part if extra is None else extra.unionByName(part)
    fresh = extra.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti")
    return base.select(*keys, *FIELDS).unionByName(fresh)


# ---- conditions over assertion search (v2 and later) -------------------------------------------

def condition_a(found: DataFrame, assertions: DataFrame, k: int = MAX_K) -> DataFrame:
    """Plain vector search, in order of similarity."""
    rows = fetch(found.where((F.col("want") == 0) & (F.col("rank") <= k)), assertions)
    return ranked_by(rows, [F.col("rank")], k).select("query_id", "rank", "assertion_id", *FIELDS)


def condition_b(found: DataFrame, assertions: DataFrame, edges: DataFrame, k: int = MAX_K) -> DataFrame:
    """Plain search widened by generic neighbours, by confidence."""
    seeds = few(condition_a(found, assertions, k))
    near = P.generic_expansion(_as_seeds(seeds, 10), edges, assertions)
    fresh = near.join(seeds.select("query_id", "assertion_id"), ["query_id", "assertion_id"], "left_anti")
    first = top_per_key(fresh, ["query_id"], [F.col("assertion_id")], k)
    return ranked(_merge(seeds, fetch(first, assertions)), k)


def condition_c(found: DataFrame, assertions: DataFrame, k: int = MAX_K) -> DataFrame:
    """Search gated by validity type before the cut; mixed queries merge both types by confidence."""
    gated = fetch(found.where((F.col("want") > 0) & (F.col("rank") <= k)), assertions)
    mixed = F.col("epistemic_type") == "mixed"
    order = [F.when(mixed, -F.col("confidence")).otherwise(F.col("rank").cast("double")), F.col("assertion_id")]
    return ranked_by(gated, order, k).select("query_id", "rank", "assertion_id", *FIELDS)


def ranked_by(rows: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """``ranked`` for an order that itself uses the old rank."""
    numbered = rows.withColumn("_new", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return numbered.where(F.col("_new") <= k).drop("rank").withColumnRenamed("_new", "rank")


def condition_d(found: DataFrame, assertions: DataFrame, edges: DataFrame, citations: DataFrame,
                variant: str = "v4", k: int = MAX_K) -> DataFrame:
    """Gated seeds, Toulmin expansion and regulation periphery, by confidence.

    ``variant``: v2 expands along proof types, v4 along argument types, and
    ``filings`` is v4 without the regulation leg.
    """
    seeds = few(condition_c(found, assertions, k))
    expansion = P.toulmin_expansion(_as_seeds(seeds, 5), edges, assertions, "v2" if variant == "v2" else "v4")
    legs = [fetch(expansion, assertions)]
    if variant != "filings":
        periphery = regulation_periphery(seeds.where("rank <= 5"), citations, assertions)
        legs.append(fetch(periphery.select("query_id", "assertion_id"), assertions))
    return ranked(_merge(seeds, *legs), k)


def conflict_flags(results: DataFrame, queries: DataFrame, edges: DataFrame) -> DataFrame:
    """Per query: whether graph contradictions join two of its results, and how many."""
    pairs = graph_contradictions(results, edges).groupBy("query_id").agg(F.count("*").alias("conflict_pairs"))
    return (queries.select("query_id").join(pairs, "query_id", "left").fillna({"conflict_pairs": 0})
            .withColumn("conflicts_detected", F.col("conflict_pairs") > 0))


# ---- conditions over chunk search (v1) ---------------------------------------------------------

def condition_a_v1(chunks: DataFrame, assertions: DataFrame) -> DataFrame:
    """All live assertions of the best chunks, by confidence."""
    rows = assertions_of_chunks(chunks.select("query_id", "chunk_id"), assertions)
    return ranked(rows).select("query_id", "rank", "assertion_id", *FIELDS)


def condition_b_v1(chunks: DataFrame, assertions: DataFrame, edges: DataFrame) -> DataFrame:
    seeds = few(condition_a_v1(chunks, assertions))
    near = P.generic_expansion(_as_seeds(seeds, 10), edges, assertions)
    fresh = near.join(seeds.select("query_id", "assertion_id"), ["query_id", "assertion_id"], "left_anti")
    first = top_per_key(fresh, ["query_id"], [F.col("assertion_id")], 50)
    return ranked(_merge(seeds, fetch(first, assertions)))


def condition_c_v1(chunks: DataFrame, queries: DataFrame, assertions: DataFrame) -> DataFrame:
    """Assertions of the best chunks, filtered by type after the cut."""
    rows = assertions_of_chunks(chunks.select("query_id", "chunk_id"), assertions).join(
        queries.select("query_id", "epistemic_type"), "query_id")
    kind, wanted = F.col("validity_claim_type"), F.col("epistemic_type")
    kept = rows.where(F.when(wanted == "mixed", kind.isin("normative", "constative"))
                      .when(wanted == "normative", kind == "normative").otherwise(kind == "constative"))
    return ranked(kept).select("query_id", "rank", "assertion_id", *FIELDS)


def condition_d_v1(chunks: DataFrame, queries: DataFrame, assertions: DataFrame, edges: DataFrame,
                   citations: DataFrame) -> DataFrame:
    seeds = few(condition_c_v1(chunks, queries, assertions))
    expansion = P.toulmin_expansion(_as_seeds(seeds, 5), edges, assertions, "v1")
    periphery = regulation_periphery(seeds.where("rank <= 5"), citations, assertions)
    legs = [fetch(expansion, assertions), fetch(periphery.select("query_id", "assertion_id"), assertions)]
    return ranked(_merge(seeds, *legs))


# ---- seeds and variants ------------------------------------------------------------------------

def neutral_seeds(found: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The single most similar assertion of each query; a stored seed wins."""
    new = found.where("want = 0 and rank = 1").select("query_id", F.col("assertion_id").alias("_new"))
    if stored is None:
        return new.withColumnRenamed("_new", "assertion_id")
    old = stored.select("query_id", F.col("assertion_id").alias("_old"))
    return (new.join(old, "query_id", "full_outer")
            .select("query_id", F.coalesce("_old", "_new").alias("assertion_id")).where("assertion_id is not null"))


def confident_seeds(results: DataFrame) -> DataFrame:
    """The result of highest confidence, the smallest id on a tie."""
    best = F.min_by("assertion_id", F.struct(-F.col("confidence"), F.col("assertion_id")))
    return results.groupBy("query_id").agg(best.alias("assertion_id"))


def repetitiveness(queries: DataFrame, vectors: DataFrame, k: int = 20) -> DataFrame:
    """Mean similarity of the best ``k`` chunks."""
    return (top_chunks(queries, vectors, k).groupBy("query_id")
            .agg(F.round(F.avg("score"), 9).alias("repetitiveness_index")))


def padded_top_k(found: DataFrame, want: int, k: int) -> DataFrame:
    """Gated results, filled up to ``k`` from the best 2k plain results.

    ``found`` must hold at least 2k plain results per query.
    """
    gated = found.where((F.col("want") == want) & (F.col("rank") <= k)).withColumn("tier", F.lit(0))
    plain = found.where((F.col("want") == 0) & (F.col("rank") <= 2 * k)).withColumn("tier", F.lit(1))
    fresh = plain.join(gated.select("query_id", "assertion_id"), ["query_id", "assertion_id"], "left_anti")
    cols = ["query_id", "assertion_id", "tier", "rank"]
    both = gated.select(*cols).unionByName(fresh.join(gated.select("query_id").distinct(), "query_id", "left_semi").select(*cols))
    return ranked_by(both, [F.col("tier"), F.col("rank")], k)
