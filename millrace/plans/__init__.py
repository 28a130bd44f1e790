"""Ready-made analyses, and dependency graphs as DataFrames and pages."""
