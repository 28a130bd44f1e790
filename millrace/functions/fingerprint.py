"""128-bit fingerprints of keys, values and DataFrames."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.codec import encode


def stable_hash(value: Any, seed: int = 0) -> str:
    """32 hex digits, the same in every process for equal values and seed."""
    return hashlib.blake2b(f"{seed}\n{encode(value)}".encode(), digest_size=16).hexdigest()


def _holds_time(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_time(kind.elementType)
    if isinstance(kind, T.MapType):
        return _holds_time(kind.keyType) or _holds_time(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_holds_time(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def _exact(c: Column, kind: T.DataType) -> Column:
    """A nested value whose times are exact: JSON would cut them to milliseconds."""
    if not _holds_time(kind):
        return c
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return c.cast("string")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return _exact(F.map_entries(c), entries)
    return F.when(c.isNotNull(), F.struct(*[_exact(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]))


def _plain(name: str, kind: T.DataType) -> Column:
    """A column as something that hashes without loss."""
    c = F.col(f"`{name}`")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return c.cast("string")  # keeps -0.0 apart from 0.0; all NaNs are one
    if isinstance(kind, T.MapType):
        entries = T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)]))
        return F.to_json(F.array_sort(_exact(F.map_entries(c), entries)), {"ignoreNullFields": "false"})
    if isinstance(kind, (T.ArrayType, T.StructType)):
        return F.to_json(_exact(c, kind), {"ignoreNullFields": "false"})
    if isinstance(kind, T.VariantType):
        return F.to_json(c)
    return c


def metrics(schema: T.StructType) -> list[Column]:
    """Aggregates whose values identify a multiset of rows: a count, and sums of 32-bit parts of two hashes.

    The hash function skips nulls, so which columns are null is hashed first. Sums do
    not depend on the order of rows and combine before any shuffle.
    """
    flags = [F.when(F.col(f"`{f.name}`").isNull(), "0").otherwise("1") for f in schema.fields]
    shape = F.concat(*flags) if flags else F.lit("")
    cols = [_plain(f.name, f.dataType) for f in schema.fields]
    out = [F.count(F.lit(1)).alias("n")]
    for seed in (1, 2):
        h = F.xxhash64(F.lit(seed), shape, *cols)
        out += [F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"lo{seed}"), F.sum(F.shiftrightunsigned(h, 32)).alias(f"hi{seed}")]
    return out


def from_metrics(schema: T.StructType, row: dict[str, Any], seed: int = 0) -> str:
    shape = [(f.name, f.dataType.simpleString()) for f in schema.fields]
    return stable_hash((shape, [int(row.get(k) or 0) for k in ("n", "lo1", "hi1", "lo2", "hi2")]), seed)


def frame_fingerprint(df: DataFrame, seed: int = 0) -> str:
    """Fingerprint of a DataFrame as a multiset of rows, in one pass."""
    return from_metrics(df.schema, df.agg(*metrics(df.schema)).first().asDict(), seed)


def slice_fingerprints(df: DataFrame, by: str, most: int, seed: int = 0) -> dict[Any, str]:
    """Fingerprints of all slices of ``df`` by one column, in one grouped job; refused over ``most`` slices."""
    rows = df.groupBy(F.col(f"`{by}`").alias("_slice")).agg(*metrics(df.schema)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} slices by {by}: make the slice a column of one node instead")
    return {r["_slice"]: from_metrics(df.schema, r.asDict(), seed) for r in rows}
