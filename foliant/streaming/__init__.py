"""Structured Streaming forms of the document store."""
