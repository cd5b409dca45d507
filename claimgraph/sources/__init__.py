"""Readers, writers and response parsers."""
