"""Embedding near-dedup with an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has a codebook
of its own (k-means on a bounded sample), and the pair of nearest codewords is
a vector's cell in the product grid.  A vector visits cells in order of how
near they can come and stops at the
target radius: both halves' codewords are sorted by their bounds, and a heap walks the grid of the two sequences
from the best pair on, so only visited cells and their neighbours are ever looked at.

The order is by a lower bound that cannot be wrong: to lie nearer to codeword
``c'`` than to its own ``c``, a half must move at least
``(|x-c'|^2 - |x-c|^2) / (2 |c-c'|)``.  Cells whose two bounds together exceed
the radius of the threshold (cosine 0.98: distance 0.2) hold no link, so with
``REACH = 1`` the recall is one; a smaller reach trades recall for visits.

Identical vectors of one label are one class with a multiplicity, so copies
are never expanded.  Each class is written once: a range partitioning by label
and cell packs runs of vectors into blocks of at most ``BLOCK_BYTES``, and
tasks read pairs of blocks of a label from that one table in the shared folder
(a Cartesian product of few, large rows, which shuffles nothing), so a vector
costs the same disk however many cells are visited.  Within a pair the vectors
of a cell traverse the grid together, by the least of their bounds, and meet
those vectors of the visited cells that could reach their cell.  A sure bound
from a third of the dimensions comes before the cosine in double precision.
A task returns a count for each vector and a spanning forest of the block's
links, never all pairs.  Rows find their class by 128 bits of hashes.

Cases: vectors that are null or zero or hold null or non-finite components,
and rows whose label or id is null, link with nothing; vectors of different
lengths never link; a single vector or an empty table gives itself; repeated
rows each get their row and count as other vectors; columns other than id,
vector and label are not read.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.ship import release, shared_folder, ship

THRESHOLD = 0.98
#: Share of the threshold's radius that visits reach; 1 is exact.
REACH = 1.0
#: Most classes on which the codebooks are fit, and vectors for which a label's cell is meant.
FIT_ROWS = 4096
BLOCK = 256
#: Most bytes of vectors in a block, blocks in a file, folders of labels, and numbers of a matrix of products.
BLOCK_BYTES = 4 << 20
FILE_BLOCKS = 4
MAX_FOLDERS = 64
CELLS = 1 << 21
#: Numbers of a product for each visited cell up to which one product takes them all; larger ones leave out who does not visit the cell.
SMALL = 1 << 12
#: What single precision may take from a bound.
SLACK = 1e-5
#: Codewords a half, at least and at most.
MIN_CODEWORDS = 8
MAX_CODEWORDS = 64


def _codebook(half: np.ndarray, k: int) -> np.ndarray:
    """k-means from evenly spaced rows; the same for the same rows."""
    words = half[np.linspace(0, len(half) - 1, k).astype(int)].copy()
    for _ in range(12):
        near = ((words**2).sum(1) - 2 * half @ words.T).argmin(1)
        for n in range(k):
            if (near == n).any():
                words[n] = half[near == n].mean(0)
    return np.unique(words, axis=0)


def _bounds(half: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest codeword of each row, and how far the row is from being nearest to each other one at least (squared)."""
    d = (half**2).sum(1)[:, None] - 2 * half @ words.T + (words**2).sum(1)
    near = d.argmin(1)
    apart = np.sqrt(((words[:, None] - words[None]) ** 2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        low = (d - d[np.arange(len(d)), near][:, None]) / (2 * apart[near])
    low[np.arange(len(d)), near] = 0
    return near, np.maximum(low, 0) ** 2


def visits(low1: np.ndarray, low2: np.ndarray, radius: float) -> list[int]:
    """Multi-sequence traversal: cells of the product grid whose two bounds add up to ``radius`` or less, nearest first."""
    o1, o2 = np.argsort(low1, kind="stable").tolist(), np.argsort(low2, kind="stable").tolist()
    a, b = low1[o1].tolist(), low2[o2].tolist()
    out, heap = [], [(a[0] + b[0], 0, 0)]
    while heap:
        low, i, j = heapq.heappop(heap)
        if low > radius:
            break
        out.append(o1[i] * len(b) + o2[j])
        if i + 1 < len(a):
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))
        if not i and j + 1 < len(b):
            heapq.heappush(heap, (a[0] + b[j + 1], 0, j + 1))
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _forest(linked: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` (left by right) connects."""
    big = np.iinfo(np.int64).max
    a, b = left.copy(), right.copy()
    while True:
        na = np.minimum(a, np.where(linked, b[None, :], big).min(1))
        nb = np.minimum(b, np.where(linked, na[:, None], big).min(0))
        if (na == a).all() and (nb == b).all():
            break
        a, b = na, nb
    return [(int(x), int(y)) for x, y in {*zip(left, a, strict=True), *zip(right, b, strict=True)} if x != y]


class _Block:
    """Vectors of one length, sorted by label and cell, with what comparisons need of them."""

    def __init__(self, dims: int, ids: bytes, mult: bytes, labels: bytes, cells: bytes, vecs: bytes, kind: np.dtype, books: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        self.ids, self.mult, self.cells = (np.frombuffer(x, dtype=np.int64) for x in (ids, mult, cells))
        self.raw = np.frombuffer(vecs, dtype=kind).reshape(len(self.ids), dims)
        names, starts = np.unique(np.frombuffer(labels, dtype=np.int64), return_index=True)
        self.runs = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(self.ids)], strict=True), strict=True))
        x = _unit(self.raw.astype(np.float64))
        if dims in books:
            one, two = books[dims]
            half = max(1, dims // 2)
            self.low1, self.low2 = (_bounds(h, w)[1].astype(np.float32) for h, w in ((x[:, :half], one), (x[:, half:], two)))
        else:
            self.low1 = self.low2 = np.zeros((len(x), 1), dtype=np.float32)
        # x . y is at most the product of the first dimensions and that of the lengths of what remains.
        first = -(-dims // 3)
        self.short = np.concatenate([x[:, :first], np.sqrt((x[:, first:] ** 2).sum(1, keepdims=True))], axis=1).astype(np.float32)

    def groups(self, label: int) -> list[tuple[int, int, int]]:
        """(cell, from, to) of a label's vectors."""
        a, z = self.runs[label]
        cells, starts = np.unique(self.cells[a:z], return_index=True)
        return list(zip((cells & 0xFFFFFFFF).tolist(), (starts + a).tolist(), [*(starts[1:] + a).tolist(), z], strict=True))


def _compare(p: _Block, q: _Block, same: bool, threshold: float, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Parts of the links between two blocks, or inside one: matrix, rows in ``p``, rows in ``q``, forest."""
    far, near = 2 - 2 * threshold + SLACK, (2 - 2 * threshold) * reach * reach + SLACK
    wide = p.low2.shape[1]

    def met(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]]:
        step = max(1, CELLS // max(1, len(right)))
        for n in range(0, len(left) if len(right) else 0, step):
            could = p.short[left[n : n + step]] @ q.short[right].T >= threshold - SLACK
            if not could.any():
                continue
            x, y = left[n : n + step][could.any(1)], right[could.any(0)]
            linked = _unit(p.raw[x].astype(np.float64)) @ _unit(q.raw[y].astype(np.float64)).T >= threshold
            if same:
                linked &= p.ids[x][:, None] != q.ids[y][None, :]
            if linked.any():
                yield linked, x, y, _forest(linked, p.ids[x], q.ids[y])

    for label in p.runs.keys() & q.runs.keys():
        there, (start, end) = {c: (a, z) for c, a, z in q.groups(label)}, q.runs[label]
        # Only codewords of the cells at hand are traversed.
        firsts, seconds = (np.unique([f(c, wide) for c in there]) for f in (int.__floordiv__, int.__mod__))
        for cell, a, z in p.groups(label):
            low1, low2 = p.low1[a:z][:, firsts], p.low2[a:z][:, seconds]
            grid = [divmod(v, len(seconds)) for v in visits(low1.min(0), low2.min(0), near)]
            seen = [(m, n, c) for m, n in grid if (c := int(firsts[m]) * wide + int(seconds[n])) in there]
            i, j = divmod(cell, wide)
            reach_back = q.low1[start:end, i] + q.low2[start:end, j] <= far
            if (z - a) * np.count_nonzero(reach_back) <= SMALL * len(there):
                if len(seen) < len(there):
                    held = np.zeros(end - start, dtype=bool)
                    for _, _, c in seen:
                        held[there[c][0] - start : there[c][1] - start] = True
                    reach_back &= held
                yield from met(np.arange(a, z), np.flatnonzero(reach_back) + start)
            else:
                for m, n, c in seen:
                    at = np.flatnonzero(reach_back[there[c][0] - start : there[c][1] - start]) + there[c][0]
                    if len(at):
                        yield from met(np.flatnonzero(low1[:, m] + low2[:, n] <= near) + a, at)


def link(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, reach: float = REACH) -> DataFrame:
    """One row per input row: ``vec_id``, ``n_links``, ``component_id``, ``kept``."""
    spark = rows.sparkSession
    ship(spark)
    shared_folder(spark)
    base = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"), F.col(label_col).alias("label"))
    sound = F.coalesce(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0),
        F.lit(False),
    )
    marked = base.withColumn("sound", sound)
    # Classes of equal vectors; the hashes keep the grouping from comparing arrays first, and rows find their class by them.
    valid = marked.where("sound").select("vec_id", "label", "vec", F.xxhash64("label", "vec").alias("h"), F.xxhash64(F.lit(7), "vec", "label").alias("h2"))
    light = valid.groupBy("h", "h2").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult")).checkpoint()
    total = light.count()
    # As the table grows, so does the grid.
    k = int(np.clip(round((total / (4 * BLOCK)) ** 0.5), MIN_CODEWORDS, MAX_CODEWORDS))
    chosen = light.orderBy(F.xxhash64("cid"), "h", "h2").limit(FIT_ROWS).select("h", "h2", "cid")
    sample = valid.join(F.broadcast(chosen), ["h", "h2"]).where(F.col("vec_id") == F.col("cid")).dropDuplicates(["h", "h2"]).select("h", "h2", F.col("vec").cast("array<double>").alias("vec")).toPandas().sort_values(["h", "h2"])
    books: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dims, group in sample.groupby(sample["vec"].map(len)):
        x = _unit(np.stack(group["vec"].to_list()).astype(float))
        half = max(1, int(dims) // 2)
        books[int(dims)] = (_codebook(x[:, :half], min(k, len(x))), _codebook(x[:, half:], min(k, len(x))) if dims > 1 else np.zeros((1, 0)))
    shared = spark.sparkContext.broadcast(books)  # 2 * MAX_CODEWORDS half vectors for each length in the sample
    # Single numbers are kept as such, and compared in double precision.
    kind = np.dtype(np.float32 if isinstance(rows.schema[vec_col].dataType.elementType, T.FloatType) else np.float64)
    data = int(total * kind.itemsize * (sample["vec"].map(len).mean() if len(sample) else 1))
    most = int(np.clip(data // 16, 1 << 16, BLOCK_BYTES))
    folders, files = int(np.clip(data // (2 * BLOCK_BYTES), 1, MAX_FOLDERS)), 1 + data // (FILE_BLOCKS * most)

    @F.pandas_udf("cell long, packed binary")
    def place(vecs: pd.Series) -> pd.DataFrame:
        cells, packed = [0] * len(vecs), [b""] * len(vecs)
        by_size: dict[int, list[int]] = {}
        for n, v in enumerate(vecs):
            by_size.setdefault(len(v), []).append(n)
        for dims, at in by_size.items():
            raw = np.stack([np.asarray(vecs.iat[n], dtype=kind) for n in at])
            first = dims << 32  # lengths never meet
            if dims in shared.value:
                one, two = shared.value[dims]
                x = _unit(raw.astype(np.float64))
                half = max(1, dims // 2)
                own = _bounds(x[:, :half], one)[0] * len(two) + _bounds(x[:, half:], two)[0]
            else:  # a length the sample lacks: one cell, visited by all
                own = np.zeros(len(at), dtype=int)
            for i, n in enumerate(at):
                cells[n] = first + int(own[i])
                packed[n] = raw[i].tobytes()
        return pd.DataFrame({"cell": cells, "packed": packed})

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, made, held, size, key = TaskContext.get().partitionId(), 0, [], 0, None

        def block() -> pd.DataFrame:
            names, cells, ids, mult, vecs = zip(*held, strict=True)
            longs = {c: [np.array(x, dtype=np.int64).tobytes()] for c, x in (("ids", ids), ("mult", mult), ("labels", names), ("cells", cells))}
            return pd.DataFrame({"folder": [key[0]], "bid": [(part << 32) + made], "dims": [key[1]], "least": [names[0]], "largest": [names[-1]], **longs, "vecs": [b"".join(vecs)]})

        for b in batches:
            for folder, dims, *row in zip(*(b[c] for c in ("folder", "dims", "name", "cell", "cid", "mult", "packed")), strict=True):
                if held and (key != (folder, dims) or size + len(row[-1]) > most):
                    yield block()
                    made, held, size = made + 1, [], 0
                key = folder, dims
                held.append(row)
                size += len(row[-1])
        if held:
            yield block()

    # Labels other than integers go by their hash.
    name = F.col("label").cast("long") if isinstance(rows.schema[label_col].dataType, T.IntegralType) else F.xxhash64("label")
    classes = valid.groupBy("h", "h2", "label", "vec").agg(F.min("vec_id").alias("cid"), F.count("*").alias("mult"))
    placed = classes.select("cid", "mult", name.alias("name"), place(F.col("vec")).alias("p")).select("cid", "mult", "name", "p.*", F.pmod("name", F.lit(folders)).cast("int").alias("folder"), F.shiftright("p.cell", 32).alias("dims"))
    order = ["folder", "dims", "name", "cell", F.xxhash64("cid")]
    schema = "folder int, bid long, dims long, least long, largest long, ids binary, mult binary, labels binary, cells binary, vecs binary"
    columns = ["bid", "dims", "least", "largest", "ids", "mult", "labels", "cells", "vecs"]
    path = f"{spark.sparkContext.getCheckpointDir()}/embedding-blocks-{uuid.uuid4().hex}"

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict[int, _Block] = {}

        def side(r: dict, s: str) -> _Block:
            bid = r[f"{s}_bid"]
            if bid not in cache:
                while len(cache) > FILE_BLOCKS:
                    del cache[next(iter(cache))]
                cache[bid] = _Block(r[f"{s}_dims"], *(r[f"{s}_{c}"] for c in ("ids", "mult", "labels", "cells", "vecs")), kind, shared.value)
            else:
                cache[bid] = cache.pop(bid)
            return cache[bid]

        for b in batches:
            for r in b.to_dict("records"):
                p, q, same = side(r, "p"), side(r, "q"), r["p_bid"] == r["q_bid"]
                # Inside a block both orders of a pair are met, so only one side counts.
                here, there = np.zeros(len(p.ids)), np.zeros(len(q.ids))
                edges: set[tuple[int, int]] = set()
                for linked, left, right, forest in _compare(p, q, same, threshold, reach):
                    here[left] += linked @ q.mult[right].astype(float)
                    if not same:
                        there[right] += p.mult[left].astype(float) @ linked
                    edges.update(forest)
                ids, n = np.concatenate([p.ids, q.ids]), np.concatenate([here, there]).astype(np.int64)
                a, z = zip(*edges, strict=True) if edges else ((), ())
                yield pd.DataFrame({"a": pd.Series([*ids[n > 0].tolist(), *a], dtype="int64"), "b": pd.Series([*[None] * int((n > 0).sum()), *z], dtype="Int64"), "n": pd.Series([*n[n > 0].tolist(), *[0] * len(a)], dtype="int64")})

    try:
        placed.repartitionByRange(files, *order).sortWithinPartitions(*order).mapInPandas(pack, schema).write.partitionBy("folder").option("compression", "none").parquet(path)
        del classes, placed
        release(spark)  # from here on the blocks are all that is left of the vectors
        blocks = spark.read.schema(schema).parquet(path)
        pairs = [spark.createDataFrame([], ", ".join(f"{s}_{x}" for s in "pq" for x in schema.split(", ")[1:]))]
        for x in blocks.select("folder").distinct().collect():
            p, q = (blocks.where(F.col("folder") == x.folder).select(*(F.col(c).alias(f"{s}_{c}") for c in columns)) for s in "pq")
            # Two comparisons in place of an equality, which would be a reason to shuffle.
            pairs.append(p.join(q, (F.col("p_bid") <= F.col("q_bid")) & (F.col("p_dims") <= F.col("q_dims")) & (F.col("p_dims") >= F.col("q_dims")) & (F.col("p_least") <= F.col("q_largest")) & (F.col("p_largest") >= F.col("q_least"))))
        found = reduce(DataFrame.unionByName, pairs[1:] or pairs).mapInPandas(compare, "a long, b long, n long").checkpoint()
    finally:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)  # noqa: SLF001
    roots = components(found.where("b is not null"), "a", "b")
    counts = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("linked"))
    answer = light.join(counts, "cid", "left").join(roots, F.col("cid") == F.col("node"), "left").select("h", "h2", (F.coalesce("linked", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "cid").alias("component_id"))
    good = valid.select("vec_id", "h", "h2").join(answer, ["h", "h2"]).select("vec_id", "n_links", "component_id")
    alone = marked.where(~F.col("sound")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
