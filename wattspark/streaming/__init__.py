"""Structured Streaming: ingest of collector text and streaming versions of the batch operators."""
