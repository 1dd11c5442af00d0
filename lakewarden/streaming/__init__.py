"""Incremental ingestion on Structured Streaming."""
