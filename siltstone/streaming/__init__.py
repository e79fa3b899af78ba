"""Structured Streaming ingest and continuous queries."""
