"""Structured Streaming forms of the windowed signal statistics."""
