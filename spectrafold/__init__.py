"""Spectral profiles of large object tables, written as Spark DataFrame jobs."""
