"""Structured Streaming ingest: JSON log values from a stream source, and incremental
ingest of new raw files."""
