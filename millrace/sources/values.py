"""Values of nodes: plain Python values, table references, and stored DataFrames.

A DataFrame that an executor returns is lazy and could read a later version
of its sources, so it is written once as Parquet, and its fingerprint is
taken in the same pass (as observed metrics of the write).  Files are kept
under their fingerprint: equal results share one copy.

A ``TableRef`` names files that exist already, with an optional predicate and
columns.  It is a value of its own that is never copied, however large
the table; its fingerprint comes from the files' names, sizes and times.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import types as T

from millrace.functions.codec import register_class
from millrace.functions.fingerprint import from_metrics, metrics, stable_hash
from millrace.sources.files import Files


@dataclass(frozen=True)
class TableRef:
    """Files at ``path``, read as ``format``; rows by ``where`` (SQL), columns by ``columns``."""

    path: str
    format: str = "parquet"
    where: str | None = None
    columns: tuple[str, ...] | None = None
    options: tuple[tuple[str, str], ...] = ()

    def frame(self, spark: SparkSession) -> DataFrame:
        df = spark.read.format(self.format).options(**dict(self.options)).load(self.path)
        df = df.where(self.where) if self.where else df
        return df.select(*self.columns) if self.columns else df


@dataclass(frozen=True)
class Stored:
    """A DataFrame that was written; ``schema`` is its JSON."""

    path: str
    schema: str

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(T.StructType.fromJson(json.loads(self.schema))).parquet(self.path)


@dataclass(frozen=True)
class Slice:
    """The rows of a stored DataFrame whose column ``by`` equals ``key``; read by a filter that reaches the scan."""

    path: str
    schema: str
    by: str
    key: Any

    def frame(self, spark: SparkSession) -> DataFrame:
        df = Stored(self.path, self.schema).frame(spark)
        return df.where(df[self.by].eqNullSafe(self.key))


for _c in (TableRef, Stored, Slice):
    _c.__type_name__ = f"millrace.{_c.__name__}"
    register_class(_c.__type_name__, _c)


class ValueStore:
    """Keeps DataFrames below ``root``."""

    def __init__(self, spark: SparkSession, root: str, seed: int) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self.seed = seed
        self.files = Files(spark)

    def keep(self, value: Any) -> tuple[Any, str]:
        """(what to remember, its fingerprint)."""
        if isinstance(value, DataFrame):
            return self._write(value)
        if isinstance(value, TableRef):
            return value, stable_hash((value, self.files.stats(value.path)), self.seed)
        return value, stable_hash(value, self.seed)

    def show(self, value: Any) -> Any:
        """What executors and users get to see."""
        return value.frame(self.spark) if isinstance(value, (TableRef, Stored, Slice)) else value

    def _write(self, df: DataFrame) -> tuple[Stored, str]:
        staged = f"{self.root}/staged/{uuid.uuid4().hex}"
        watch = Observation()
        # Small results need one file; what is large keeps its partitions.
        df.observe(watch, *metrics(df.schema)).write.parquet(staged)
        digest = from_metrics(df.schema, watch.get, self.seed)
        home = f"{self.root}/values/{digest}"
        if self.files.exists(home):
            self.files.delete(staged)
        else:
            self.files.make_folder(f"{self.root}/values")
            if not self.files.rename(staged, home):
                self.files.delete(staged)
        return Stored(home, df.schema.json()), digest

    def prune(self, used: set[str]) -> int:
        """Delete stored values whose paths are not in ``used``; how many."""
        gone = [n for n in self.files.names(f"{self.root}/values") if f"{self.root}/values/{n}" not in used]
        for n in gone:
            self.files.delete(f"{self.root}/values/{n}")
        self.files.delete(f"{self.root}/staged")
        return len(gone)
