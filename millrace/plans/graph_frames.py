"""Dependency graphs as data: exports, closures and firewall sets by joins.

For graphs of tables the engine works in the driver.  For graphs of rows
(millions of edges) the same rules are joins here: each step touches only the edges out of
what the step before has found, and what was found is cut from its lineage by
files in the cluster's shared folder.

A graph of several kinds of ids may be given by kinds: edges as {(kind of caller, kind of callee): table},
ids as {kind: table}.  A step then reads only the tables whose kinds it meets, and what it finds
is held only against what was found of that kind.  An id belongs to one kind.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.engine import Engine
from millrace.operators.graph import NodeId, describe, str_id

NODES = "id string, type_name string, key string, kind string, fingerprint string, firewalls array<string>, verified long, is_input boolean, depth int"
EDGES = "caller string, callee string, place int, grp int, is_dirty boolean, seen string"


def shared_checkpoints(spark: SparkSession) -> None:
    """Make sure that there is a folder for checkpoints: the cluster's own, or one for tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "/tmp/checkpoints"))


def snapshot(engine: Engine, root: object | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) below a key, breadth first with depths; of the whole graph without one."""
    nodes, edges = snapshot_records(engine, root)
    spark = engine.spark
    return spark.createDataFrame([tuple(n.values()) for n in nodes], NODES), spark.createDataFrame([tuple(e.values()) for e in edges], EDGES)


def snapshot_records(engine: Engine, root: object | None = None) -> tuple[list[dict], list[dict]]:
    with engine.lock:
        graph = engine.graph
        if root is None:
            depth = dict.fromkeys(graph.nodes, 0)
        else:
            start = NodeId.of(root, engine.seed)
            depth, level = {start: 0} if start in graph.nodes else {}, [start]
            while level:
                level = [c for n in level if n in graph.nodes for c in graph.nodes[n].callees() if c in graph.nodes and c not in depth and not depth.update({c: depth[n] + 1})]
        nodes = [describe(n, graph.nodes[n]) | {"depth": d} for n, d in depth.items()]
        edges = []
        for n in depth:
            node = graph.nodes[n]
            for place, item in enumerate(node.order):
                for c in item if isinstance(item, tuple) else (item,):
                    seen = node.seen.get(c)
                    edges.append({"caller": str_id(n), "callee": str_id(c), "place": place, "grp": place if isinstance(item, tuple) else -1, "is_dirty": (n, c) in graph.dirty, "seen": seen.value if seen else None})
        return nodes, edges


Edges = DataFrame | Mapping[tuple[str, str], DataFrame]
Ids = DataFrame | Mapping[str, DataFrame]


def _by_kind(edges: Edges, *ids: Ids) -> list[dict]:
    """All by kinds; without any, everything is of one kind."""
    typed = isinstance(edges, Mapping)
    if any(isinstance(x, Mapping) != typed for x in ids):
        raise TypeError("edges and ids must be given by kinds both, or neither")
    return [dict(edges) if typed else {("", ""): edges}, *[dict(x) if typed else {"": x} for x in ids]]


def _union(frames: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, frames)


def _kept(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and read from there: no lineage, and a size by which Spark chooses joins."""
    path = f"{df.sparkSession.sparkContext.getCheckpointDir()}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _touching(edges: DataFrame, end: str, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The edges whose ``end`` is (or with "left_anti", is not) among ``ids``; Spark takes these joins below a distinct()."""
    return edges.select("caller", "callee").join(ids.select(F.col("id").alias(end)), end, how)


def _unseen(found: Mapping[str, list[DataFrame]], seen: Mapping[str, list[DataFrame]], by: list[str]) -> dict[str, DataFrame]:
    """Of each kind the distinct rows found that are not yet among those seen; kinds without any are left out."""
    new = {}
    for kind, frames in found.items():
        rows = _union(frames).distinct()
        if kind in seen:
            rows = rows.join(_union(seen[kind]).select(*by), by, "left_anti")
        rows = _kept(rows)
        if not rows.isEmpty():
            new[kind] = rows
    return new


def dirty_closure(edges: Edges, changed: Ids, stops: Ids | None = None, most: int = 1000) -> DataFrame:
    """Edges (``caller``, ``callee``, ``step``) to be marked after ``changed`` (one column, ``id``).

    Edges into a node of ``stops`` (``id``: firewalls and projections) are marked, but lead no further.
    """
    parts, frontier, *walls = _by_kind(edges, changed, *([] if stops is None else [stops]))
    spark = next(iter(parts.values())).sparkSession
    shared_checkpoints(spark)
    leading = {callee for _, callee in parts}
    frontier = {kind: ids.select("id").distinct() for kind, ids in frontier.items() if kind in leading}
    seen = {kind: [ids] for kind, ids in frontier.items()}
    out: list[DataFrame] = []
    for step in range(1, most + 1):
        up: dict[str, list[DataFrame]] = {}
        for (caller, callee), part in parts.items():
            if callee not in frontier:
                continue
            hit = _kept(_touching(part, "callee", frontier[callee]).select("caller", "callee"))
            out.append(hit.withColumn("step", F.lit(step)))
            if caller not in leading:  # no edge leads on from there
                continue
            ids = hit.select(F.col("caller").alias("id")).distinct()
            if walls and caller in walls[0]:
                ids = ids.join(walls[0][caller].select("id"), "id", "left_anti")
            up.setdefault(caller, []).append(ids)
        frontier = _unseen(up, seen, ["id"])
        if not frontier:
            return _union(out or [part.select("caller", "callee", F.lit(0).alias("step")).where("false") for part in parts.values()])
        for kind, ids in frontier.items():
            seen.setdefault(kind, []).append(ids)
    raise RuntimeError(f"no end after {most} steps")


def firewall_sets(edges: Edges, firewalls: Ids, most: int = 1000) -> DataFrame:
    """(``id``, ``firewall``): for every caller the firewalls it depends on, the first on each way down."""
    parts, walls = _by_kind(edges, firewalls)
    spark = next(iter(parts.values())).sparkSession
    shared_checkpoints(spark)
    plain = {k: _touching(part, "callee", walls[k[1]], "left_anti") if k[1] in walls else part for k, part in parts.items()}
    more: dict[str, list[DataFrame]] = {}
    for (caller, callee), part in parts.items():
        if callee in walls:
            more.setdefault(caller, []).append(_touching(part, "callee", walls[callee]).select(F.col("caller").alias("id"), F.col("callee").alias("firewall")))
    found: dict[str, list[DataFrame]] = {}
    for _ in range(most + 1):
        new = _unseen(more, found, ["id", "firewall"])
        if not new:
            return _union([x for frames in found.values() for x in frames] or [part.select(F.col("caller").alias("id"), F.col("callee").alias("firewall")).where("false") for part in parts.values()])
        more = {}
        for kind, rows in new.items():
            found.setdefault(kind, []).append(rows)
        for (caller, callee), part in plain.items():
            if callee in new:
                more.setdefault(caller, []).append(part.join(new[callee].withColumnRenamed("id", "callee"), "callee").select(F.col("caller").alias("id"), "firewall"))
    raise RuntimeError(f"no end after {most} steps")


def breadth_first(edges: Edges, roots: Ids, most: int = 1000) -> DataFrame:
    """(``id``, ``depth``) of everything that ``roots`` (``id``) depend on."""
    parts, level = _by_kind(edges, roots)
    shared_checkpoints(next(iter(parts.values())).sparkSession)
    level = {kind: _kept(ids.select("id").distinct()) for kind, ids in level.items()}
    seen = {kind: [ids] for kind, ids in level.items()}
    out = [ids.withColumn("depth", F.lit(0)) for ids in level.values()]
    for depth in range(1, most + 1):
        below: dict[str, list[DataFrame]] = {}
        for (caller, callee), part in parts.items():
            if caller in level:
                below.setdefault(callee, []).append(_touching(part, "caller", level[caller]).select(F.col("callee").alias("id")))
        level = _unseen(below, seen, ["id"])
        if not level:
            return _union(out)
        for kind, ids in level.items():
            seen.setdefault(kind, []).append(ids)
            out.append(ids.withColumn("depth", F.lit(depth)))
    raise RuntimeError(f"no end after {most} levels")
