"""Tessera: dataset engineering on PySpark (DataFrame, SQL and Structured Streaming)."""
