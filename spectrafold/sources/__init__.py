"""Readers and builders of the canonical long tables, and the result sinks."""
