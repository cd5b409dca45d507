"""Registered queries: each pairs a Spark plan with SQL that checks it."""
