"""MinHash near-dedup by Order MinHash, verified by banded alignment.

A text is its words (see ``wordhash``).  Its k-mers are windows of ``K`` words,
labelled with their occurrence number in the text, so repetition counts.  For
each of ``BANDS`` random orders the ``TAKE`` least labelled k-mers are chosen
and *kept in text order*; their sequence is the band's key.  Two texts agree
in a band with a probability that follows their edit similarity: shared k-mers
in another order do not agree.

Texts with the same words are one node and only nodes are compared.  In a
bucket (equal band keys) every node is compared with the bucket's hub, the
member that sits in the largest buckets altogether: pairs grow with the
bucket, never with its square.  Members that are near their hub (``NEAR``) but
not linked with it are then compared with the member most similar to the hub, since a
copy's most similar text is the text it was copied from.  A hub's members are
spread over all tasks, and each task streams them past one copy of the hub.

What this links is closed to components.  A hub whose members still stand in several components is *open*, and every
pair across them that can be linked is compared.  Which can be is exact: of two linked texts the smaller one shares 8/9
of its k-mers with the other, and the larger one 4/5 of its own; those in common with the hub are known, so the pair
must share a known number of k-mers that the hub lacks.  A member that shares too few of these with members of other components is
closed.  What is left is dealt into blocks of about ``BLOCK_ROWS`` texts; each block of possible smaller
ones meets each block of possible larger ones in a task of its own, and a matrix product of their k-mers leaves only pairs that may reach
``THRESHOLD``.  So all pairs that agree in a band and are similar enough end in one class, and no bucket, however large,
is cut or skipped; texts that share a passage, or are copies edited each in its own way, cost no more than their k-mers.
Only groups whose members share rare k-mers crosswise, such as form letters, cost block against block; no pair becomes a row.
As with any index of sketches recall is measured, not proven: see the tests and the README.

A pair is verified on its whole texts: words are aligned inside a band as wide
as a similarity of ``THRESHOLD`` allows, and the similarity is the number of k-mers inside
aligned runs over the number of k-mers of both (a Jaccard similarity that
respects order).  Links are closed to components, whose smallest id is the class id.

Cases: texts of 1 to K-1 words have one k-mer, all their words, and empty and
null texts have none: they are near only to their own kind; ids may be of any type that has an order, and
several texts may share an id; a row with a null id belongs to
its class but never names it (its class id is null if all ids are null);
repeated rows each get their row; ties go to the smaller id; other columns
are kept by ``deduplicate``, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import slim, wordhash
from millrace.llm.components import components
from millrace.llm.ship import release, shared_folder, ship, tidy

K = 5
TAKE = 2
BANDS = 10
THRESHOLD = 0.8
NEAR = 0.3
#: A block of an open hub has about so many texts and words, or less.
BLOCK_ROWS = 128
BLOCK_WORDS = 1 << 17
#: Columns of k-mers that are multiplied at once.
WIDE = 4096

_ODD = [np.uint64((0x9E3779B97F4A7C15 * (2 * s + 3) + 0x1234567) & 0xFFFFFFFFFFFFFFFF | 1) for s in range(BANDS)]
_SALT = [np.uint64((0xD1B54A32D192ED03 * (s + 1)) & 0xFFFFFFFFFFFFFFFF) for s in range(BANDS)]


def _labelled(win: np.ndarray, count: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number in their text mixed in."""
    text = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    with np.errstate(over="ignore"):
        key = win + text * np.uint64(0xA0761D6478BD642F)
        order = np.argsort(key, kind="stable")
        again = np.flatnonzero(key[order][1:] == key[order][:-1]) + 1
        if not len(again):
            return win
        occurrence = np.zeros(len(win), dtype=np.uint64)
        run = 0
        last = -2
        for p in again.tolist():
            run = run + 1 if p == last + 1 else 1
            occurrence[order[p]] = run
            last = p
        return np.where(occurrence > 0, wordhash.mix(win + occurrence * np.uint64(0xE7037ED1A0B428DB)), win)


def sketch(win: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(texts with k-mers, BANDS) keys: the least labelled k-mers of each band in text order."""
    lab = _labelled(win, count)
    some = count[count > 0]
    start = np.cumsum(some) - some
    owner = np.repeat(np.arange(len(some)), some)
    out = np.zeros((len(some), BANDS), dtype=np.uint64)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        for s in range(BANDS):
            v = (lab ^ _SALT[s]) * _ODD[s]
            v ^= v >> np.uint64(31)
            places = []
            for _ in range(TAKE):
                least = np.minimum.reduceat(v, start)
                at = np.flatnonzero(v == least[owner])
                first = np.ones(len(at), dtype=bool)
                first[1:] = owner[at[1:]] != owner[at[:-1]]
                at = at[first]
                places.append(at)
                v[at] = top
            chosen = np.sort(np.stack(places), axis=0)  # text order
            key = np.zeros(len(some), dtype=np.uint64)
            for row in chosen:
                key = wordhash.mix(key * np.uint64(0x9E3779B97F4A7C15) + lab[row])
            out[:, s] = key
    return out


def _shingles(words: np.ndarray) -> np.ndarray:
    return wordhash.windows(words.astype(np.uint64), np.array([0, len(words)]), K)[0]


def _runs(a: list[int], b: list[int], most: int) -> list[tuple[int, int]] | None:
    """Matched runs (start in a, length) of an alignment with at most ``most`` insertions and deletions; None if there is none.

    Furthest-reaching points by diagonal: only diagonals within ``most`` of the main one are ever looked at.
    """
    n, m = len(a), len(b)
    reach: dict[int, tuple[int, tuple | None]] = {1: (0, None)}
    for d in range(most + 1):
        for k in range(-d, d + 1, 2):
            if k == -d or (k != d and reach[k - 1][0] < reach[k + 1][0]):
                x, path = reach[k + 1]
            else:
                x, path = reach[k - 1]
                x += 1
            y = x - k
            s = x
            while x < n and y < m and a[x] == b[y]:
                x += 1
                y += 1
            if x - s >= K:
                path = (path, s, x - s)
            reach[k] = (x, path)
            if x >= n and y >= m:
                out = []
                while path is not None:
                    path, s, size = path
                    out.append((s, size))
                return out
    return None


class Shingled:
    """A text as word hashes with its k-mers."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.shingles = _shingles(words)

    @functools.cached_property
    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(self.shingles, return_counts=True)

    @functools.cached_property
    def labelled(self) -> np.ndarray:
        return _labelled(self.shingles, np.array([len(self.shingles)]))


def compare(one: np.ndarray | Shingled, other: np.ndarray | Shingled) -> float:
    """Similarity of two texts given as word hashes: exact at or above ``THRESHOLD``, an upper bound of it below."""
    x, y = (t if isinstance(t, Shingled) else Shingled(t) for t in (one, other))
    a, b = x.words, y.words
    if len(a) == len(b) and (a == b).all():
        return 1.0
    total = len(x.shingles) + len(y.shingles)
    if not total:
        return 1.0
    (ua, ca), (ub, cb) = x.counts, y.counts
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    bound = both / (total - both)
    if bound < THRESHOLD or min(len(a), len(b)) < K:
        return bound
    least = int(np.ceil(THRESHOLD / (1 + THRESHOLD) * total))
    # As many words must be aligned as k-mers are needed, and K - 1 more; what is left over bounds the band.
    runs = _runs(a.tolist(), b.tolist(), len(a) + len(b) - 2 * (least + K - 1))
    if runs is None:
        return min(bound, THRESHOLD - 1e-9)
    kept = sum(n - K + 1 for _, n in runs)
    return kept / (total - kept)


#: Fixed columns of a sketch.
_KEYS = [f"k{n}" for n in range(BANDS)]


def _node(words: np.ndarray) -> int:
    """64 bits that stand for a text's words."""
    return int.from_bytes(hashlib.blake2b(words.tobytes(), digest_size=8).digest(), "little", signed=True)


def _plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``text`` and ``digest``, a hash of the text: two rows that agree in id and digest are repeats."""
    return docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("digest"))


def _sketches(plain: DataFrame) -> DataFrame:
    """One row per input row: ``id``, ``digest``, ``node`` and the band keys (null without k-mers)."""

    @F.pandas_udf("node long, keys array<long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            nodes: list[int] = []
            keys: list[list[int] | None] = []
            for h, cuts, first, end in wordhash.grouped(list(texts)):
                win, count = wordhash.windows(h, cuts, K)
                found = iter(sketch(win, count).view(np.int64).tolist() if len(win) else [])
                for n in range(end - first):
                    nodes.append(_node(h[cuts[n] : cuts[n + 1]]))
                    keys.append(next(found) if count[n] else None)
            yield pd.DataFrame({"node": nodes, "keys": keys})
        tidy()

    return plain.select("id", "digest", run("text").alias("s")).select("id", "digest", "s.node", *[F.get("s.keys", F.lit(n)).alias(k) for n, k in enumerate(_KEYS)])


def _words(plain: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``node``, ``words``) of the ``wanted`` (node, id): 32 bits for each word."""

    @F.pandas_udf("node long, words binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            out = []
            for h, cuts, first, end in wordhash.grouped(list(texts)):
                for n in range(end - first):
                    own = h[cuts[n] : cuts[n + 1]]
                    out.append((_node(own), (own >> np.uint64(32)).astype(np.uint32).tobytes()))
            yield pd.DataFrame(out, columns=["node", "words"])
        tidy()

    # Only documents whose id falls in the bucket of a wanted one are read as words.
    some = plain.join(slim.buckets(wanted, "b", F.xxhash64("id")), slim.bucket(F.xxhash64(plain["id"])) == F.col("b"), "left_semi")
    return some.select(run("text").alias("w")).select("w.*").join(wanted.select("node"), "node", "left_semi").groupBy("node").agg(F.first("words").alias("words"))


def _past_hub(pairs: DataFrame, words: DataFrame, schema: str, look: Callable[[Shingled, Shingled], tuple]) -> DataFrame:
    """``pairs`` (hub, node) with what ``look`` returns for the hub and the node.

    The hub's words are sent once to each task that has members of it, and come before them.
    """
    parts = max(64, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = pairs.select("hub", F.pmod(F.xxhash64("node"), F.lit(parts)).alias("part"), "node")
    members = spread.join(words, "node").select("hub", "part", F.lit(True).alias("member"), "node", "words")
    hubs = spread.select("hub", "part").distinct().join(words, F.col("hub") == F.col("node")).select("hub", "part", F.lit(False).alias("member"), "node", "words")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hub = None
        for b in batches:
            out = []
            for h, member, node, w in zip(b["hub"].tolist(), b["member"].tolist(), b["node"].tolist(), b["words"], strict=True):
                text = Shingled(np.frombuffer(w, dtype=np.uint32))
                if member:
                    out.append((h, node, *look(hub, text)))
                else:
                    hub = text
            yield pd.DataFrame(out, columns=["hub", "node", *[x.split()[0] for x in schema.split(", ")]])
        hub = text = None
        tidy()

    return members.unionByName(hubs).repartition("hub", "part").sortWithinPartitions("hub", "part", "member").mapInPandas(run, f"hub long, node long, {schema}")


def _novelty(hub: Shingled, text: Shingled) -> tuple[list[int], int, int]:
    """The labelled k-mers that the hub lacks, and how many of them a text linked with this one must have as well if this one is the smaller, or the larger."""
    both = len(np.intersect1d(hub.labelled, text.labelled, assume_unique=True))
    novel = np.setdiff1d(text.labelled, hub.labelled, assume_unique=True)
    size = len(text.labelled)
    least = lambda share: int(np.ceil(share * size - 1e-9)) - both
    return novel.view(np.int64).tolist(), least(2 * THRESHOLD / (1 + THRESHOLD)), least(THRESHOLD)


def _stars(members: DataFrame) -> DataFrame:
    """``members`` (key, node) as distinct pairs (hub, node): each bucket's members with its hub."""
    sizes = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    inside = members.join(sizes, "key")
    weight = inside.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = inside.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("h")).select("key", F.col("h.node").alias("hub"))
    return inside.join(hubs, "key").where(F.col("node") != F.col("hub")).select("hub", "node").distinct()


def _recentred(seen: DataFrame) -> DataFrame:
    """Each hub's near members that are not linked with it, with the member most similar to the hub."""
    near = seen.where(F.col("sim") >= NEAR)
    best = near.groupBy("hub").agg(F.max(F.struct("sim", "node")).alias("b")).select("hub", F.col("b.node").alias("centre")).checkpoint()
    return near.where(F.col("sim") < THRESHOLD).join(best, "hub").where("node <> centre").select(F.col("centre").alias("hub"), "node").distinct()


def _possible(pairs: DataFrame, words: DataFrame, roots: DataFrame) -> DataFrame:
    """(``hub``, ``node``, ``label``, ``small``) of the members of open hubs that can be linked with a member of another component; ``small``: as the smaller one."""
    label = F.coalesce("root", F.col("p.node")).alias("label")
    named = pairs.alias("p").join(roots.select(F.col("node").alias("of"), "root"), F.col("p.node") == F.col("of"), "left").select("hub", "p.node", label).checkpoint()
    # Each of these is written before it is joined on the hub, so that Spark can split a large hub's rows.
    open_ = named.groupBy("hub").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("hub").checkpoint()
    going = named.join(open_, "hub", "left_semi").checkpoint()
    new = _past_hub(going.select("hub", "node"), words, "novel array<long>, smaller long, larger long", _novelty).join(going, ["hub", "node"]).checkpoint()
    rare = new.select("hub", "node", "label", F.explode("novel").alias("n"))
    shared = rare.groupBy("hub", "n").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p <> q").select("hub", "n")
    held = rare.join(shared, ["hub", "n"]).groupBy("hub", "node").agg(F.count("*").alias("held"))
    fits = new.drop("novel").join(held, ["hub", "node"], "left").withColumn("held", F.coalesce("held", F.lit(0))).where("held >= larger")
    return fits.select("hub", "node", "label", (F.col("held") >= F.col("smaller")).alias("small"))


def _shared(words: list[bytes], left: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of labelled k-mers in common of each of the first ``left`` texts with each other one, and the number of each text."""
    size = np.array([len(w) // 4 for w in words])
    win, count = wordhash.windows(np.frombuffer(b"".join(words), dtype=np.uint32).astype(np.uint64), np.concatenate([[0], np.cumsum(size)]), K)
    owner = np.repeat(np.arange(len(words)), count)
    _, column = np.unique(_labelled(win, count), return_inverse=True)
    # Columns that both sides have.
    sides = [np.bincount(column[owner < left], minlength=len(win)) > 0, np.bincount(column[owner >= left], minlength=len(win)) > 0]
    common = sides[0] & sides[1]
    some = common[column]
    owner, column = owner[some], (np.cumsum(common) - 1)[column[some]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((left, len(words) - left), dtype=np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, WIDE):
        a, b = np.searchsorted(column, [at, at + WIDE])
        part = np.zeros((len(words), min(WIDE, int(column[-1]) + 1 - at)), dtype=np.float32)
        part[owner[a:b], column[a:b] - at] = 1
        both += part[:left] @ part[left:].T
    return both, count


def _link_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that connect all linked texts of a block of smaller and a block of larger ones."""
    rows = rows.sort_values("larger", kind="stable")
    left = int((~rows["larger"]).sum())
    label, node = rows["label"].to_numpy(), rows["node"].to_numpy()
    out: list[tuple[int, int]] = []
    if 0 < left < len(rows):
        both, count = _shared(rows["words"].tolist(), left)
        x, y = count[:left, None], count[None, left:]
        first = (x < y) | ((x == y) & (node[:left, None] < node[None, left:]))  # each pair once
        fits = first & (label[:left, None] != label[None, left:]) & (both >= (THRESHOLD - 1e-6) * (x + y - both))
        text = [np.frombuffer(w, dtype=np.uint32) for w in rows["words"]]
        root = {v: v for v in label.tolist()}

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = v = root[root[v]]
            return v

        for i, j in zip(*(v.tolist() for v in np.nonzero(fits)), strict=True):
            p, q = find(int(label[i])), find(int(label[left + j]))
            if p != q and compare(text[i], text[left + j]) >= THRESHOLD:
                root[p] = q
                out.append((int(node[i]), int(node[left + j])))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _open_links(pairs: DataFrame, words: DataFrame, roots: DataFrame) -> DataFrame:
    """(a, b) links between components of ``roots`` (node, root) whose texts stand with one hub of ``pairs`` (hub, node)."""
    weights = words.select("node", F.greatest(F.lit(1 / BLOCK_ROWS), F.length("words") / 4 / BLOCK_WORDS).alias("weight"))
    inside = _possible(pairs, words, roots).join(weights, "node").checkpoint()
    layout = inside.groupBy("hub").agg(
        F.ceil(F.sum(F.when(F.col("small"), F.col("weight")))).cast("int").alias("smalls"), F.ceil(F.sum("weight")).cast("int").alias("larges"), F.min("label").alias("p"), F.max("label").alias("q")
    )
    layout = layout.where("p <> q and smalls > 0").select("hub", "smalls", "larges").checkpoint()
    placed = inside.join(layout, "hub").select("hub", "node", "label", "small", "smalls", "larges", F.xxhash64("node").alias("h"))
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod("h", F.col(n)).cast("int")
    smaller = placed.where("small").select("hub", own("smalls").alias("s"), upto("larges").alias("l"), F.lit(False).alias("larger"), "node", "label")
    larger = placed.select("hub", upto("smalls").alias("s"), own("larges").alias("l"), F.lit(True).alias("larger"), "node", "label")
    return smaller.unionByName(larger).join(words, "node").groupBy("hub", "s", "l").applyInPandas(_link_blocks, "a long, b long").distinct()


def _rooted(plain: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (id, digest, node) of the input, and (node, root, cid, n_copies) of the nodes; ``cid`` is the smallest id of its component."""
    rows = _sketches(plain).checkpoint()
    groups = rows.groupBy("node").agg(F.min("id").alias("own"), F.count("*").alias("n_copies"), *[F.first(k).alias(k) for k in _KEYS]).checkpoint()
    keyed = groups.where(F.col("k0").isNotNull()).select("node", F.posexplode(F.array(*_KEYS)).alias("band", "k"))
    pairs = _stars(keyed.select(F.xxhash64("band", "k").alias("key"), "node")).checkpoint()
    wanted = pairs.select("node").union(pairs.select("hub")).distinct().join(groups.select("node", F.col("own").alias("id")), "node").checkpoint()
    words = _words(plain, wanted).checkpoint()
    release(plain.sparkSession)
    look = lambda hub, text: (compare(hub, text),)
    seen = _past_hub(pairs, words, "sim double", look).checkpoint()
    again = _past_hub(_recentred(seen).checkpoint(), words, "sim double", look)
    edges = seen.unionByName(again).where(F.col("sim") >= THRESHOLD).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    roots = components(edges, "a", "b", local=True)
    release(plain.sparkSession)
    late = _open_links(pairs, words, roots).checkpoint()
    if not late.isEmpty():
        roots = components(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).union(late), "a", "b", local=True)
    nodes = groups.select("node", "own", "n_copies").join(roots, "node", "left").select("node", "own", "n_copies", F.coalesce("root", "node").alias("root"))
    names = nodes.groupBy("root").agg(F.min("own").alias("cid")).checkpoint()  # written, so that Spark can split a large class
    return rows.select("id", "digest", "node"), nodes.select("node", "n_copies", "root").join(names, "root")


def _ready(docs: DataFrame) -> None:
    ship(docs.sparkSession)
    shared_folder(docs.sparkSession)


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``class_id`` (smallest id of its near-duplicate class), ``n_copies`` (rows with the same words, itself included)."""
    _ready(docs)
    rows, nodes = _rooted(_plain(docs, id_col, text_col))
    return rows.join(nodes, "node").select(F.col("id").alias("doc_id"), F.col("cid").alias("class_id"), "n_copies")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id, and all documents without an id; all columns of ``docs``."""
    _ready(docs)
    rows, nodes = _rooted(_plain(docs, id_col, text_col))
    some = rows.where(F.col("id").isNotNull()).join(nodes.select("node", "root"), "node").groupBy("root", "id", "digest").agg(F.count("*").alias("times")).checkpoint()
    first = some.groupBy("root").agg(F.min(F.struct("id", "digest")).alias("stays")).checkpoint()
    # Rows that go, and rows that stay but repeat; no other row is shuffled.
    acted = some.join(first, "root").select("id", "digest", "times", (F.struct("id", "digest") == F.col("stays")).alias("stays")).where("not stays or times > 1").select("id", "digest", "stays").checkpoint()
    mine, h, taken = slim.free("near", docs.columns), slim.free("digest", docs.columns), slim.free("bucket", docs.columns)
    acted = acted.select(F.col("id").alias(mine), F.col("digest").alias(h), "stays")
    key = F.xxhash64(docs[id_col], F.xxhash64(docs[text_col]))
    sided = docs.join(slim.buckets(acted, taken, F.xxhash64(mine, h)), (slim.bucket(key) == F.col(taken)) & docs[id_col].isNotNull(), "left")
    apart = sided.where(F.col(taken).isNotNull()).withColumn(h, F.xxhash64(F.col(text_col)))
    gone = acted.where("not stays").select(F.col(mine), F.col(h).alias(slim.free("other", [*docs.columns, h])))
    left = apart.join(gone, (apart[id_col] == gone[mine]) & (apart[h] == gone[gone.columns[1]]), "left_anti").dropDuplicates([id_col, h])
    return sided.where(F.col(taken).isNull()).select(*docs.columns).unionByName(left.select(*docs.columns))
