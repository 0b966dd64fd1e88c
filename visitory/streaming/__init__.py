"""Structured Streaming forms of ingest and visits."""
