"""The incremental engine: keys, executors, sessions, evaluation, invalidation and repair."""
