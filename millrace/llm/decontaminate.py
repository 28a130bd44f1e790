"""Benchmark decontamination by template canonicalisation.

Words are canonicalised into typed placeholders: a word that starts with a
digit is ``<number>``, a unit word right after a number is ``<unit>``, and a
capitalised word that does not open a sentence is ``<name>``.  All windows of
``K`` canonical words of the benchmark are hashed into a table; the
documents' windows are looked up in it, and so are the windows of the words as they stand, since what opens a
sentence in one text may not do so in the other.  For an item whose windows a
document holds to ``SHARE`` or more, the slots are read off along the runs of
matched windows: the same filler of the item must always stand for the same
filler in the document, and for another one than other fillers do (a
re-parameterised question).  Where the fillers are equal it is a plain copy.

The benchmark is a stated query set.  Where it has at most ``BLOCK_ITEMS`` items and ``BLOCK_BYTES`` bytes, which is
checked before, its window table is broadcast and the join is a lookup in it.  A larger one is joined by hash, with nothing of it on the driver
or broadcast: the documents' distinct windows meet the items' windows in a shuffle, places are counted by document and
item, and only pairs that reach ``SHARE`` are read again for their slots.

Cases: null and empty texts hold no item; an item of fewer than ``K`` words
has one window, all its words, and is found where a document's own words are
exactly these; items without words are ignored; equal items with different ids are all reported, repeated rows of an item once;
repeated rows each get their row; other columns are kept by ``clean``; an
empty benchmark rejects nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import slim, wordhash
from millrace.llm.ship import shared_folder, ship, tidy

K = 5
SHARE = 0.8
FOUND = "array<struct<item_id:long,share:double,copied:boolean>>"
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20

# Unit words.
UNITS = "mm cm m km in ft mi mg g kg t lb oz ml l s sec min h hr hours hour minutes minute seconds second days day weeks week months month years year percent usd eur dollars dollar euros euro cents cent meters meter metres metre kilometers kilometer miles mile feet foot inches inch grams gram kilograms kilogram pounds pound liters liter litres litre degrees degree celsius kmh mph".split()

NUMBER, UNIT, NAME = (wordhash.mix(np.array([n], dtype=np.uint64))[0] for n in (11, 12, 13))


@dataclass
class Read:
    """A text's canonical words, the hashes of the words themselves, and which are slots."""

    template: np.ndarray
    filler: np.ndarray

    @property
    def slot(self) -> np.ndarray:
        return self.template != self.filler


_UNIT_HASHES: list[np.ndarray] = []
_SENTENCE = np.zeros(256, dtype=bool)
_SENTENCE[[ord(c) for c in ".!?:;\n\"|"]] = True


def _units() -> np.ndarray:
    if not _UNIT_HASHES:
        _UNIT_HASHES.append(np.unique(np.array([wordhash.hash_of(u) for u in UNITS], dtype=np.uint64)))
    return _UNIT_HASHES[0]


def canonical(w: wordhash.Words) -> np.ndarray:
    """The canonical words of a block."""
    out = w.hash.copy()
    if not len(out):
        return out
    lead = w.raw[w.start]
    number = (lead >= 48) & (lead <= 57)
    after_number = np.zeros(len(out), dtype=bool)
    after_number[1:] = number[:-1] & (w.text[1:] == w.text[:-1])
    at = np.flatnonzero(after_number)
    unit = np.zeros(len(out), dtype=bool)
    unit[at] = np.isin(w.hash[at], _units())
    upper = (lead >= 65) & (lead <= 90)
    c3 = np.flatnonzero((lead == 0xC3) & (w.end - w.start > 1))
    second = w.raw[w.start[c3] + 1]
    upper[c3] = (second >= 0x80) & (second <= 0x9E)
    ends = np.cumsum(_SENTENCE[w.raw])
    opens = np.ones(len(out), dtype=bool)
    opens[1:] = ends[w.start[1:]] > ends[w.end[:-1] - 1]
    out[upper & ~opens] = NAME
    out[unit] = UNIT
    out[number] = NUMBER
    return out


def read(texts: list[str | None]) -> Iterator[tuple[int, Read]]:
    """(number of the text, its words) for each text with words; whole texts."""
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    now = -1
    for w in wordhash.blocks(texts):
        c = canonical(w)
        cuts = np.flatnonzero(np.diff(w.text, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            t = int(w.text[a])
            if t != now and parts:
                yield now, Read(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                parts = []
            now = t
            parts.append((c[a:b], w.hash[a:b]))
    if parts:
        yield now, Read(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _windows(words: np.ndarray) -> np.ndarray:
    return wordhash.windows(words, np.array([0, len(words)]), K)[0]


class Table:
    """The windows of some items: sorted hashes, and for each the (item, place) pairs."""

    def __init__(self, items: list[tuple[int, str | None]]) -> None:
        self.ids = [i for i, _ in items]
        self.texts: dict[int, Read] = dict(read([t for _, t in items]))
        rows = sorted({(int(h), n, p) for n, r in self.texts.items() for form in (r.template, r.filler) for p, h in enumerate(_windows(form).tolist())})
        self.total = {n: max(1, len(r.template) - K + 1) for n, r in self.texts.items()}
        order = np.array([r[0] for r in rows], dtype=np.uint64).argsort(kind="stable") if rows else np.zeros(0, np.int64)
        every = np.array([r[0] for r in rows], dtype=np.uint64)[order] if rows else np.zeros(0, np.uint64)
        self.item = np.array([r[1] for r in rows], dtype=np.int64)[order] if rows else np.zeros(0, np.int64)
        self.place = np.array([r[2] for r in rows], dtype=np.int64)[order] if rows else np.zeros(0, np.int64)
        self.hash, self.first = np.unique(every, return_index=True)
        self.last = np.append(self.first[1:], len(every))
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(self.hash >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``h`` that are in the table, and where in the table."""
        at = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        k = np.searchsorted(self.hash, h[at])
        ok = (k < len(self.hash)) & (self.hash[np.minimum(k, len(self.hash) - 1)] == h[at]) if len(self.hash) else np.zeros(len(at), dtype=bool)
        return at[ok], k[ok]

    def judge(self, doc: Read, at: np.ndarray, k: np.ndarray) -> list[tuple[int, float, bool]]:
        """(item id, share of its windows, equal fillers) for the items that the document holds."""
        by_item: dict[int, list[tuple[int, int]]] = {}
        for d, w in zip(at.tolist(), k.tolist(), strict=True):
            for r in range(self.first[w], self.last[w]):
                by_item.setdefault(int(self.item[r]), []).append((int(self.place[r]), d))
        out = []
        for item, pairs in by_item.items():
            share = len({p for p, _ in pairs}) / self.total[item]
            if share >= SHARE:
                kept, same = self._consistent(self.texts[item], doc, pairs)
                if kept / self.total[item] >= SHARE:
                    out.append((self.ids[item], kept / self.total[item], same))
        return out

    def _consistent(self, item: Read, doc: Read, pairs: list[tuple[int, int]]) -> tuple[int, bool]:
        """The most windows that one consistent reading of the slots covers, and whether its fillers are the item's own."""
        # One reading for each stretch of the document: windows that lie as far apart as in the item, within its length.
        stretches: list[list[tuple[int, int]]] = []
        for p, d in sorted(pairs, key=lambda x: (x[1] - x[0], x[1])):
            if stretches and abs((d - p) - (stretches[-1][-1][1] - stretches[-1][-1][0])) <= K:
                stretches[-1].append((p, d))
            else:
                stretches.append([(p, d)])
        best, same = 0, False
        size = min(K, len(item.template))
        for stretch in stretches:
            there: dict[int, int] = {}
            back: dict[int, int] = {}
            kept: set[int] = set()
            equal = True
            for p, d in sorted(stretch, key=lambda x: x[1]):
                new = [(int(item.filler[p + j]), int(doc.filler[d + j])) for j in range(size) if item.slot[p + j]]
                if all(there.get(a, b) == b and back.get(b, a) == a for a, b in new):
                    for a, b in new:
                        there[a], back[b] = b, a
                        equal &= a == b
                    kept.add(p)
            if len(kept) > best:
                best, same = len(kept), equal
        return best, same


def find(texts: list[str | None], table: Table) -> list[list[dict]]:
    """For each text the items that it holds."""
    out: list[list[dict]] = [[] for _ in texts]
    for n, doc in read(texts):
        at, k = (np.concatenate(x) for x in zip(table.hits(_windows(doc.template)), table.hits(_windows(doc.filler)), strict=True))
        if len(at):
            out[n] = [{"item_id": i, "share": round(s, 6), "copied": c} for i, s, c in sorted(table.judge(doc, at, k))]
    return out


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``item`` (a hash of id and text), ``item_id``, ``text`` of the usable items."""
    rows = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].alias("text")).where("item_id is not null and text is not null")
    return rows.distinct().select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text")


def _small(items: DataFrame) -> list[tuple[int, str]] | None:
    """The items if they are few and short enough to be broadcast."""
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if size["n"] > BLOCK_ITEMS or size["b"] > BLOCK_BYTES:
        return None
    return [(r["item_id"], r["text"]) for r in items.collect()]


def _lookup(spark: SparkSession, items: list[tuple[int, str]]) -> Callable[[Column], Column]:
    """A function that finds the items, which are broadcast (``BLOCK_ITEMS`` and ``BLOCK_BYTES`` bound them)."""
    shared = spark.sparkContext.broadcast(items)

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = Table(shared.value)
        for texts in batches:
            yield pd.Series(find(list(texts), table), dtype=object)
        tidy()

    return run


def _item_windows(texts: pd.Series) -> pd.Series:
    out: list[list] = [[] for _ in texts]
    for n, r in read(list(texts)):
        out[n] = [{"w": w, "place": p} for w, p in {(w, p) for form in (r.template, r.filler) for p, w in enumerate(_windows(form).view(np.int64).tolist())}]
    return pd.Series(out, dtype=object)


def _text_windows(texts: pd.Series) -> pd.Series:
    out: list = [[] for _ in texts]
    for n, r in read(list(texts)):
        out[n] = np.union1d(_windows(r.template), _windows(r.filler)).view(np.int64).tolist()
    return pd.Series(out, dtype=object)


def _judged(ids: pd.Series, items: pd.Series, texts: pd.Series) -> pd.Series:
    return pd.Series([find([t], Table([(i, x)]))[0] for i, x, t in zip(ids, items, texts, strict=True)], dtype=object)


def _by_join(plain: DataFrame, items: DataFrame) -> DataFrame:
    """(``digest``, ``found``) for the texts of ``plain`` (digest, text) that hold an item."""
    item_windows, text_windows, judged = F.pandas_udf(_item_windows, "array<struct<w:long,place:int>>"), F.pandas_udf(_text_windows, "array<long>"), F.pandas_udf(_judged, FOUND)
    windows = items.select("item", F.explode(item_windows("text")).alias("x")).select("item", "x.w", "x.place").checkpoint()
    total = windows.groupBy("item").agg(F.count_distinct("place").alias("total"))
    seen = plain.select("digest", F.explode(text_windows("text")).alias("w"))
    seen = seen.join(slim.buckets(windows, "b", F.xxhash64("w")), slim.bucket(F.xxhash64(seen["w"])) == F.col("b"), "left_semi").distinct()
    held = seen.join(windows, "w").select("digest", "item", "place").distinct().groupBy("digest", "item").agg(F.count("*").alias("n"))
    pairs = held.join(total, "item").where(F.col("n") >= SHARE * F.col("total")).select("digest", "item").checkpoint()
    few = plain.join(slim.buckets(pairs, "b", F.col("digest")), slim.bucket(plain["digest"]) == F.col("b"), "left_semi").join(pairs.select("digest").distinct(), "digest", "left_semi")
    texts = few.groupBy("digest").agg(F.min("text").alias("text"))
    both = pairs.join(texts, "digest").join(items.select("item", "item_id", F.col("text").alias("item_text")), "item")
    # One entry for each item that a text holds.
    return both.select("digest", F.explode(judged("item_id", "item_text", "text")).alias("x")).groupBy("digest").agg(F.array_sort(F.collect_list("x")).alias("found"))


def marked(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", name: str = "contamination") -> DataFrame:
    """``docs`` with a column of the items each holds: array of item_id, share, copied."""
    spark = docs.sparkSession
    ship(spark)
    items = _items(benchmark, item_col, item_text_col)
    small = _small(items)
    if small is not None:
        return docs.withColumn(name, _lookup(spark, small)(docs[text_col]))
    shared_folder(spark)
    found = _by_join(docs.select(F.xxhash64(docs[text_col]).alias("digest"), docs[text_col].alias("text")), items)
    mine, got = slim.free("digest", docs.columns), slim.free("found", docs.columns)
    found = found.select(F.col("digest").alias(mine), F.col("found").alias(got))
    none = F.array().cast(FOUND)
    return docs.join(found, F.xxhash64(docs[text_col]) == F.col(mine), "left").select(*[docs[c] for c in docs.columns], F.coalesce(got, none).alias(name))


def flagged(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per input row: ``doc_id``, ``contaminated``, ``n_items``, ``item_ids``, ``best_share``."""
    m = marked(docs.select("doc_id", "text"), benchmark)
    c = F.col("contamination")
    best = F.coalesce(F.array_max(F.transform(c, lambda x: x["share"])), F.lit(0.0))
    return m.select("doc_id", (F.size(c) > 0).alias("contaminated"), F.size(c).cast("long").alias("n_items"), F.array_sort(F.transform(c, lambda x: x["item_id"])).alias("item_ids"), best.alias("best_share"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no item, with their columns."""
    name = slim.free("contamination", docs.columns)
    return marked(docs, benchmark, name=name).where(F.size(name) == 0).drop(name)
