"""Structured Streaming forms of the polled jobs."""
