"""Imports every query module so that the registry is complete."""

from claimgraph.plans import registry
from claimgraph.plans import (  # noqa: F401
    analytics_queries,
    graph_queries,
    metric_queries,
    path_queries,
    stream_queries,
    retrieval_queries,
    inference_queries,
    conflict_queries,
    source_queries,
    assertion_queries,
    curation_queries,
    text_queries,
)

QUERIES = registry.QUERIES
CHECKS = registry.CHECKS
