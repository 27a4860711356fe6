"""Structured Streaming entry points: file-arrival ingest and notification
flattening."""
