"""URL filters: a cascade of Bloom filters that is exact over the corpus's own keys.

A *key* is a host suffix followed by a path prefix, such as ``com/en/``.  A
rule lists such a key; a host list names keys with an empty path.  For a URL
only the suffixes with as many labels as some listed host, and the prefixes
as long as some listed path, can be listed keys, so each URL has a small
fixed number of candidate keys however long it is.

The universe is every distinct candidate key of the corpus.  Level 0 holds the listed keys;
level 1 holds the universe's keys that wrongly pass level 0; level 2 the
listed keys that wrongly pass level 1; and so on until a level lets nothing
wrong pass.  A key belongs to the list iff the first level it fails has an
odd number (or it passes all levels and their number is odd).  Over the
universe this is exact, so judging URLs needs no join at all.

The size of the levels is bounded by the *list*, not by the corpus: level 0 is
made for so low a rate that about ``FP_PER_KEY`` keys of the universe pass
wrongly for each listed key, and later levels hold no more keys than that.
Only these false positives reach the driver, and their number is checked.
Lists of over ``SHARD_KEYS`` keys are split into shards with a cascade each;
cascades over ``MAX_CASCADE_BYTES`` in all are refused.

Cases: null URLs and URLs without ``://`` have empty host and path, meet no
rule and are allowed; of rules that fit, the longest wins (at equal length the
smaller rule string; a key that is listed for both verdicts counts as block);
repeated rows each get their row; an empty table gives an empty result;
columns other than the id and the URL are not read.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.ship import ship

#: Most false positives of level 0 for each listed key.
FP_PER_KEY = 1.0
#: Bytes of all levels that may be broadcast together.
MAX_CASCADE_BYTES = 64 << 20
#: Most listed keys in one shard; the keys of four shards are broadcast while cascades are built.
SHARD_KEYS = 250_000
MAX_LEVELS = 64


@dataclass(frozen=True)
class Rule:
    """``verdict`` (``allow`` or ``block``) for hosts that are ``host`` or end with ``.host``, on paths that start with ``path``."""

    verdict: str
    host: str
    path: str = ""

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased."""
    raw = F.regexp_extract(url, r"://([^/?#]*)", 1)
    return F.coalesce(F.translate(raw, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """An array of (key, length of its host part): the only keys of this URL that can be listed."""
    n = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    parts = []
    for k in labels:
        suffix = F.substring_index(host, ".", -k)
        for size in lengths:
            fits = (host != "") & (n >= k) & (F.length(path) >= size)
            parts.append(F.when(fits, F.struct(F.concat(suffix, F.substring(path, 1, size)).alias("key"), F.length(suffix).alias("host_len"))))
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key), F.xxhash64(F.lit(1), key)]


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, k: int, bits: int) -> np.ndarray:
    """k bit positions for each key (double hashing, another start for each level)."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        steps = np.arange(k, dtype=np.uint64) + np.uint64((level * 64 + 1) & 0xFFFFFFFF)
        x = a[:, None] + steps[None, :] * b[:, None]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
    return x % np.uint64(bits)


@dataclass
class Level:
    """One Bloom filter: ``words`` of 64 bits, ``k`` hash functions."""

    words: np.ndarray
    k: int

    @property
    def bits(self) -> int:
        return len(self.words) * 64

    def passes(self, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        p = _positions(h1, h2, level, self.k, self.bits)
        hit = (self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1)
        return hit.all(axis=1)


def listed(levels: list[Level], h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Exact membership for keys of the universe."""
    out = np.full(len(h1), len(levels) % 2 == 1)
    open_ = np.ones(len(h1), dtype=bool)
    for n, level in enumerate(levels):
        if not open_.any():
            break
        at = np.flatnonzero(open_)
        failed = at[~level.passes(h1[at], h2[at], n)]
        out[failed] = n % 2 == 1
        open_[failed] = False
    return out


def _level(h1: np.ndarray, h2: np.ndarray, rate: float, number: int) -> Level:
    """A Bloom filter of these keys that lets a share ``rate`` of other keys pass."""
    count = max(1, len(h1))
    words = max(1, math.ceil(count * -math.log(rate) / math.log(2) ** 2 / 64))
    k = min(24, max(1, round(words * 64 / count * math.log(2))))
    p = _positions(h1, h2, number, k, words * 64).ravel()
    bits = np.zeros(words, dtype=np.uint64)
    np.bitwise_or.at(bits, (p >> np.uint64(6)).astype(np.int64), np.uint64(1) << (p & np.uint64(63)))
    return Level(bits, k)


def build_cascades(spark: SparkSession, universe: DataFrame, keys: list[list[str]], most: int) -> list[list[Level]]:
    """One cascade for each list in ``keys`` over ``universe`` (one column, ``key``, distinct, at most ``most`` rows).

    One distributed pass finds what wrongly passes level 0 of any list. Level
    0 is sized from ``most`` so that this is about ``FP_PER_KEY`` for each
    listed key; should it be more than eight times that, level 0 is made anew
    with a smaller rate. The later levels work on what is bounded by the lists.
    """
    mine = spark.createDataFrame([(k, n) for n, ks in enumerate(keys) for k in sorted(set(ks))], "key string, list int")
    hashed = mine.select("list", *[h.alias(f"h{n + 1}") for n, h in enumerate(_hashes(F.col("key")))]).toPandas()
    inside = [(g["h1"].to_numpy(), g["h2"].to_numpy()) for n in range(len(keys)) for g in [hashed[hashed["list"] == n]]]
    own = mine.groupBy("key").agg(F.collect_set("list").alias("of"))
    outer = universe.join(F.broadcast(own), "key", "left").select(F.coalesce("of", F.array().cast("array<int>")).alias("of"), *[h.alias(f"h{n + 1}") for n, h in enumerate(_hashes(F.col("key")))])
    rates = [min(0.5, max(1e-12, FP_PER_KEY * max(len(x[0]), 1) / max(most, 1))) for x in inside]
    while True:
        first = spark.sparkContext.broadcast([_level(*x, rates[n], 0) for n, x in enumerate(inside)])

        def wrong(batches, first=first):  # noqa: ANN001, ANN202
            for b in batches:
                h1, h2 = b["h1"].to_numpy(), b["h2"].to_numpy()
                for n, level in enumerate(first.value):
                    at = np.flatnonzero(level.passes(h1, h2, 0))
                    at = [i for i in at if n not in b["of"].iat[i]]
                    yield pd.DataFrame({"list": np.full(len(at), n, dtype=np.int32), "h1": h1[at], "h2": h2[at]})

        bound = 1024 + int(8 * FP_PER_KEY * sum(len(x[0]) for x in inside))
        found = outer.mapInPandas(wrong, "list int, h1 long, h2 long").limit(bound + 1).toPandas()
        if len(found) <= bound:
            break
        rates = [r / 16 for r in rates]
    out = []
    for n, listed_ in enumerate(inside):
        g = found[found["list"] == n]
        sets, levels = [listed_, (g["h1"].to_numpy(), g["h2"].to_numpy())], [first.value[n]]
        while len(sets[len(levels) % 2][0]):
            at = len(levels)
            if at == MAX_LEVELS:
                raise RuntimeError("the cascade does not end: two keys share both hashes")
            level = _level(*sets[at % 2], 0.5, at)
            levels.append(level)
            h1, h2 = sets[(at + 1) % 2]
            ok = level.passes(h1, h2, at)
            sets[(at + 1) % 2] = (h1[ok], h2[ok])
        out.append(levels)
    return out


def judge(pages: DataFrame, rules: list[Rule], blocked_hosts: list[str], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``, ``listed_host``.

    A rule decides; where none fits, a host (or parent host) in
    ``blocked_hosts`` is blocked, and everything else is allowed.
    """
    spark = pages.sparkSession
    ship(spark)
    lists = {
        "block": {r.key for r in rules if r.verdict == "block"},
        "allow": {r.key for r in rules if r.verdict == "allow"},
        "host": {h.lower() for h in blocked_hosts},
    }
    labels = sorted({r.host.count(".") + 1 for r in rules} | {h.count(".") + 1 for h in blocked_hosts})
    lengths = sorted({len(r.path) for r in rules} | ({0} if blocked_hosts else set()))
    base = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    keyed = base.withColumn("cand", candidates(F.col("host"), F.col("path"), labels, lengths))
    universe = keyed.select(F.explode("cand").alias("c")).select("c.key").distinct()

    cut_lists = [(name, ordered[at : at + SHARD_KEYS]) for name, keys in lists.items() for ordered in [sorted(keys)] for at in range(0, len(ordered), SHARD_KEYS)]
    most = pages.count() * len(labels) * len(lengths)
    shards: list[tuple[str, list[Level]]] = []
    for k in range(0, len(cut_lists), 4):
        part = cut_lists[k : k + 4]
        shards += zip([name for name, _ in part], build_cascades(spark, universe, [keys for _, keys in part], most), strict=True)
    if sum(level.words.nbytes for _, levels in shards for level in levels) > MAX_CASCADE_BYTES:
        raise ValueError("the cascades are larger than may be broadcast; judge the lists in parts")
    filters = spark.sparkContext.broadcast(shards)

    @F.pandas_udf("array<string>")
    def in_lists(h1: pd.Series, h2: pd.Series) -> pd.Series:
        """Names of the lists that hold each candidate, in the candidates' order."""
        sizes = [len(x) for x in h1]
        a = np.concatenate([np.asarray(x, dtype=np.int64) for x in h1] or [np.zeros(0, np.int64)])
        b = np.concatenate([np.asarray(x, dtype=np.int64) for x in h2] or [np.zeros(0, np.int64)])
        names = np.full(len(a), "", dtype=object)
        for name, levels in filters.value:
            for at in np.flatnonzero(listed(levels, a, b)):
                names[at] += name + " "
        cut = np.cumsum([0, *sizes])
        return pd.Series([list(names[cut[k] : cut[k + 1]]) for k in range(len(sizes))], dtype=object)

    h1 = F.transform("cand", lambda c: _hashes(c["key"])[0])
    h2 = F.transform("cand", lambda c: _hashes(c["key"])[1])
    marked = keyed.withColumn("lists", in_lists(h1, h2))
    hit = F.filter(F.zip_with("cand", "lists", lambda c, name: F.struct(F.length(c["key"]).alias("size"), c["key"].alias("key"), c["host_len"].alias("host_len"), name.alias("name"))), lambda x: F.length(x["name"]) > 0)
    # A key can arise from two cuts between host and path only if it is the same string; a rule's own cut is checked here.
    cut = {r.key: len(r.host) for r in rules}
    where = F.create_map(*[x for k, v in sorted(cut.items()) for x in (F.lit(k), F.lit(v))]) if cut else None
    ruled = F.filter(hit, lambda x: (F.contains(x["name"], F.lit("block")) | F.contains(x["name"], F.lit("allow"))) & (where[x["key"]] == x["host_len"])) if cut else F.filter(hit, lambda x: F.lit(False))
    best = F.array_sort(ruled, lambda p, q: F.when(p["size"] != q["size"], q["size"] - p["size"]).when(p["key"] < q["key"], -1).when(p["key"] > q["key"], 1).otherwise(0))
    host_hit = F.exists(hit, lambda x: F.contains(x["name"], F.lit("host")) & (x["host_len"] == x["size"]))
    out = marked.select("page_id", "host", "path", F.get(best, F.lit(0)).alias("best"), host_hit.alias("listed_host"))
    return out.select(
        "page_id",
        "host",
        "path",
        F.col("best.key").alias("rule"),
        F.when(F.contains(F.col("best.name"), F.lit("block")), "block").when(F.col("best").isNotNull(), "allow").when(F.col("listed_host"), "block").otherwise("allow").alias("verdict"),
        "listed_host",
    )
