"""Intermediate tables that several registered queries share within one application."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from claimgraph.operators import graph as G
from claimgraph.operators import retrieval as R
from claimgraph.session import spread_narrow
from claimgraph.sources import files
from claimgraph.sources.derived import Corpus

_PATHS: dict[tuple[str, str, str], tuple[str, object]] = {}


def stored(c: Corpus, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table ``build`` makes, written to the shared folder the first time it is asked for."""
    key = (c.spark.sparkContext.applicationId, c.sf_dir, name)
    if key not in _PATHS:
        rows = build()
        path = files.scratch_folder(c.spark)
        rows.write.parquet(path)
        _PATHS[key] = (path, rows.schema)
    path, schema = _PATHS[key]
    return c.spark.read.schema(schema).parquet(path)


def graph_edges(c: Corpus) -> DataFrame:
    """Edges between assertions as a stored table, the way a graph build leaves them."""
    return stored(c, "edges", lambda: G.assertion_edges(c.relations, c.conflicts, c.assertions))


def citations(c: Corpus) -> DataFrame:
    return G.name_edges(c.assertions, "regulations")


def vectors(c: Corpus) -> DataFrame:
    """Chunk vectors as a stored table."""
    return stored(c, "vectors", lambda: spread_narrow(c.vectors, "chunk_id"))


def found(c: Corpus, k: int = 50) -> DataFrame:
    """Search results of the evaluation queries."""
    return stored(c, f"found_{k}", lambda: R.search(c.queries, c.assertions, vectors(c), k))
