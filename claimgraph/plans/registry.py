"""Registry of named queries and the composition of their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimgraph.sources.derived import CHECK_VIEWS, Corpus

Query = Callable[[Corpus], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
# Named SELECTs that several checks share, added to the derived views.
SHARED: dict[str, str] = dict(CHECK_VIEWS)


def share(name: str, sql: str) -> None:
    SHARED[name] = sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def bind(fn: Query) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = fn(Corpus(spark, sf_dir))
        # Whole numbers leave as 64-bit, the type the checking SQL counts in.
        return out.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name)
                            if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`")
                            for f in out.schema])

    return run


def compose(sql: str) -> str:
    """Prefix ``sql`` with the shared SELECTs it uses, as common table expressions."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in SHARED:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(SHARED[name])
    ordered: list[str] = []

    def place(name: str) -> None:
        if name in ordered:
            return
        for other in SHARED:
            if other != name and re.search(rf"\b{other}\b", SHARED[name]):
                place(other)
        ordered.append(name)

    for name in SHARED:
        if name in found:
            place(name)
    ctes = [f"{n} as materialized ({SHARED[n]})" for n in ordered]
    body = sql.strip()
    own = re.match(r"with\s+(recursive\s+)?", body, re.IGNORECASE)
    if not ctes:
        return body
    if own:
        recursive = "recursive " if own.group(1) else ""
        return f"with {recursive}" + ",\n".join(ctes) + ",\n" + body[own.end():]
    return "with " + ",\n".join(ctes) + "\n" + body
