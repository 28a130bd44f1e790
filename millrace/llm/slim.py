"""Small sets and names that keep large tables from being shuffled or confused.

A table's rows that a later join concerns are found first by *buckets*: the
top ``BUCKET_BITS`` bits of a key's hash, broadcast as a set of at most
2^``BUCKET_BITS`` numbers whatever the input's size.  A bucket that is hit by chance
costs a row in the join behind it, no more.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 20


def bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS)


def buckets(rows: DataFrame, name: str, h: Column) -> DataFrame:
    """The buckets of some hashes as column ``name``, for a broadcast: at most 2^BUCKET_BITS rows of one number."""
    return F.broadcast(rows.select(bucket(h).alias(name)).distinct())


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores until no column has it (Spark takes names without regard to case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name
