"""Incremental analytics on Spark: memoized queries, tracked dependencies, early cutoff."""
