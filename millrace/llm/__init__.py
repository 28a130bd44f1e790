"""Operations for training-data pipelines.

The subpackage stands alone: nothing else in the library imports it.  Each
operator lives in a module of its own; ``queries`` holds the thin driver
queries and their SQL.
"""
