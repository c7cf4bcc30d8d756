"""Incremental ingest of documents with Structured Streaming."""
