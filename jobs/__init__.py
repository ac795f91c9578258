"""Runnable jobs over the given tables, and the queries that run them."""
