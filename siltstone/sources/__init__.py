"""Readers: line protocol, NDJSON, drifting Parquet files, encoded Parquet blocks."""
