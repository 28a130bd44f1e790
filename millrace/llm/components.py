"""Connected components over an edge table, without gathering a neighbourhood anywhere.

Alternates two steps until every component is a star around its smallest node.  *Large star*: every node points
its larger neighbours to the smallest node it knows.  *Small star*: every node
points its smaller neighbours, and itself, to the smallest of them.  Each step
is a minimum by node (combined before the shuffle) and one join, so a hub with
millions of neighbours costs rows, not memory.  The minima are written before they
are joined, so that Spark can split a hub's rows over several tasks.

With ``local`` (an Arrow function, so not for native operators) tasks of at most about ``LOCAL_EDGES`` edges each
first reduce theirs to stars; where one task has them all that is the answer.  What a round has written is freed
when the next one is done; lineage is cut by ``checkpoint()`` in the cluster's shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.llm.ship import release, shared_folder, ship

#: Far above what the logarithmic number of rounds can reach.
MAX_ROUNDS = 100
LOCAL_EDGES = 1 << 19


def _star(edges: DataFrame, least: DataFrame, self_too: bool) -> DataFrame:
    """Point each ``v`` of an edge (u, v) at the least node of u."""
    out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    if self_too:
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _least(both: DataFrame) -> tuple[DataFrame, int]:
    """The least of each node and its neighbours, and how many nodes are neither a star's centre nor a leaf of one centre."""
    watch = Observation()
    around = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") < F.col("u")).alias("below"), F.count_if(F.col("v") > F.col("u")).alias("above"))
    odd = ((F.col("below") > 0) & (F.col("above") > 0)) | (F.col("below") > 1)
    kept = around.select("u", F.least("u", "m").alias("m"), odd.alias("odd")).observe(watch, F.count_if("odd").alias("n")).select("u", "m").checkpoint()
    return kept, watch.get["n"] or 0


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the edges (u, v) but the smallest of its component, with that smallest."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        least = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], least)
        np.minimum.at(root, root[b], least)
        while (root[root] != root).any():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[moved], nodes[root[moved]]


def _reduced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    every = list(batches)  # the edges of one task
    if every:
        u, v = stars(*(np.concatenate([b[c].to_numpy() for b in every]) for c in ("u", "v")))
        yield pd.DataFrame({"u": u, "v": v})


def components(edges: DataFrame, a: str, b: str, local: bool = False) -> DataFrame:
    """(``node``, ``root``) for every node that is not its component's smallest; edges with a null end are ignored."""
    spark = edges.sparkSession
    shared_folder(spark)
    now = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    if local:
        ship(spark)
        tasks = 1 + now.count() // LOCAL_EDGES
        now = now.coalesce(tasks).mapInPandas(_reduced, "u long, v long").checkpoint()
        if tasks == 1:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(MAX_ROUNDS):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, odd = _least(both)
        if not odd:
            break
        large = _star(both.where(F.col("v") > F.col("u")), least, False)
        # A node's edge to its own least neighbour is kept by that neighbour's large star or here.
        large = large.unionByName(least.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v"))).distinct().checkpoint()
        small = large.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        now = _star(large, small, True).checkpoint()
        both = least = large = small = None
        release(spark)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
