"""Structured Streaming: incremental ingest and progress windows."""
