"""Claim-graph analytics on Spark DataFrames.

Documents become chunks, chunks become typed assertions, assertions become a
graph of logical, provenance and conflict edges.  Every operator takes and
returns DataFrames (or Columns) and leaves physical planning to Catalyst.
"""

__version__ = "0.1.0"
