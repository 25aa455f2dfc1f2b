"""Incremental keyed base, batch and Structured Streaming."""
