"""Toxicity by a weighted finite-state grammar over clauses.

A text is read as clauses of words; each word has a class: *insult* (with a
weight), *threat*, *target*, *negation*, *report* or none.  Five small
transducers are composed into one machine that reads the classes and weighs
what it matches:

* reported speech: after a reporting word, the rest of its clause counts ``QUOTED``;
* negation: an insult or threat up to three words after one counts ``NEGATED``;
* target: an insult up to five words after an address counts ``AIMED``;
* threat: a threat word with an address up to three words after it is a match;
* insult: an insult word is a match with its own weight.

A text's evidence is the sum, the maximum and the number of its matched
clauses' weights, not of isolated words; a logistic curve maps it to 0..1.

What counts as an insult is learned: of words, and of word beginnings of 4 to
7 bytes, the ones that stand significantly more often in toxic than in other
labelled training texts become arcs, weighed by their log odds.  Fixed lists
give the other classes and a few insults to start from.  The fit uses at most
``FIT_ROWS`` labelled training rows (the smallest by hash of the id; of several texts with one id the least); ids with
``crc32(id as text) mod 5 = 0`` are held out and never learned from.  Labels,
language, source and id are no inputs of a score.

Cases: null and empty texts have no matched clause and get the base score; a
null id counts as the empty text for ``held_out``; repeated rows each get
their row; without usable labels the fixed lists and ``PLAIN`` coefficients
are used; whole texts are read, in blocks; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import wordhash
from millrace.llm.ship import shared_folder, ship, tidy

FIT_ROWS = 12_000
#: Likelihood-ratio statistic that a learned arc must reach, and most learned arcs.
MIN_G2 = 22.0
MAX_ARCS = 20_000
PREFIXES = (4, 5, 6, 7)
QUOTED, NEGATED, AIMED = 0.4, 0.4, 1.5
#: Coefficients for want of labels: base, sum, maximum, clauses.
PLAIN = (-3.0, 1.0, 1.0, 0.5)
SEED_WEIGHT = 2.5

# Word lists by class.
SEEDS = "idiot idiots moron stupid trash scum loser losers pathetic worthless disgusting clown imbecile bastard asshole bitch idioten dumm dummkopf arschloch abschaum widerlich salaud connard imbécile idiota imbécil estúpido basura asqueroso".split()
THREATS = "kill murder destroy hurt shoot stab beat töten umbringen schlagen tuer frapper detruire matar golpear destruir".split()
TARGETS = "you your yours u youre du dich dir dein deine ihr euch tu toi ton ta tes vous votre te ti tú usted ustedes vosotros".split()
NEGATIONS = "not never no isn't aren't don't cannot nicht kein keine nie niemals pas jamais ne ningún nunca jamás".split()
REPORTS = "said says say saying quoted called claimed wrote reported sagte schrieb nannte dit écrit appelé dijo escribió llamó".split()

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END, MATCH = "insult threat target negation report other end match".split()


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol out, weight); what has no arc passes unchanged and leads to ``fallback(state)``."""

    arcs: dict[tuple[int, str], tuple[int, str, float]]
    start: int = 0
    decay: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        if symbol == END:
            return self.start, END, 1.0
        return self.arcs.get((state, symbol), (self.decay.get(state, state), symbol, 1.0))


def _within(opener: str, width: int, closer: tuple[str, ...], factor: float, makes: str | None = None) -> Transducer:
    """After ``opener``, a ``closer`` at most ``width`` words later gets ``factor`` (and becomes ``makes``)."""
    arcs: dict[tuple[int, str], tuple[int, str, float]] = {(s, opener): (width, opener, 1.0) for s in range(width + 1)}
    for s in range(1, width + 1):
        for c in closer:
            arcs[s, c] = (0 if makes else s - 1, makes or c, factor)
    return Transducer(arcs, 0, {s: max(0, s - 1) for s in range(width + 1)})


def grammar() -> list[Transducer]:
    """The transducers in the order of composition."""
    reported = Transducer({(0, REPORT): (1, REPORT, 1.0)} | {(1, c): (1, c, QUOTED) for c in (INSULT, THREAT)})
    return [
        reported,
        _within(NEGATION, 3, (INSULT, THREAT), NEGATED),
        _within(TARGET, 5, (INSULT,), AIMED),
        _within(THREAT, 3, (TARGET,), 1.0, MATCH),
        Transducer({(0, INSULT): (0, MATCH, 1.0)}),
    ]


class Machine:
    """The composition of transducers: one table over product states, made as states are met."""

    def __init__(self, parts: list[Transducer]) -> None:
        self.parts = parts
        self.table: dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str, float]] = {}
        self.start = tuple(p.start for p in parts)

    def step(self, state: tuple[int, ...], symbol: str) -> tuple[tuple[int, ...], str, float]:
        key = (state, symbol)
        got = self.table.get(key)
        if got is None:
            after, weight = [], 1.0
            for p, s in zip(self.parts, state, strict=True):
                to, symbol, w = p.step(s, symbol)
                after.append(to)
                weight *= w
            got = self.table[key] = (tuple(after), symbol, weight)
        return got

    def clause(self, words: list[tuple[int, str, float]]) -> float:
        """The weight of a clause given its (place, class, weight) words that have a class."""
        state, at, total = self.start, None, 0.0
        for place, symbol, weight in words:
            for _ in range(0 if at is None else min(place - at - 1, 6)):
                state = self.step(state, OTHER)[0]
            state, out, factor = self.step(state, symbol)
            if out == MATCH:
                total += factor * weight
            at = place
        return total


@dataclass
class Model:
    """Learned arcs by prefix size (0: whole word) as sorted hashes and weights, and the curve's coefficients."""

    arcs: dict[int, tuple[np.ndarray, np.ndarray]]
    curve: tuple[float, ...] = PLAIN


@functools.cache
def _listed() -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the fixed lists' words, sorted, and their class numbers."""
    rows = sorted({wordhash.hash_of(w): n for n, ws in enumerate((THREATS, TARGETS, NEGATIONS, REPORTS)) for w in ws}.items())
    return np.array([r[0] for r in rows], dtype=np.uint64), np.array([r[1] for r in rows])


def _find(hashes: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where ``hashes`` are in the sorted ``table``: places in both."""
    if not len(table) or not len(hashes):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A bit per 16-bit slice first: most words end here.
    seen = np.zeros(1 << 16, dtype=bool)
    seen[(table >> np.uint64(48)).astype(np.int64)] = True
    at = np.flatnonzero(seen[(hashes >> np.uint64(48)).astype(np.int64)])
    k = np.searchsorted(table, hashes[at])
    ok = (k < len(table)) & (table[np.minimum(k, len(table) - 1)] == hashes[at])
    return at[ok], k[ok]


_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;\n"]] = True


def evidence(texts: list[str | None], model: Model, machine: Machine) -> np.ndarray:
    """For each text: sum, maximum and number of its matched clauses' weights."""
    out = np.zeros((len(texts), 3))
    names = (THREAT, TARGET, NEGATION, REPORT)
    table, number = _listed()
    for w in wordhash.blocks(texts):
        weight = np.zeros(len(w.hash))
        for size, (arcs, weights) in model.arcs.items():
            at, k = _find(w.prefix(size) if size else w.hash, arcs)
            weight[at] = np.maximum(weight[at], weights[k])
        insults = np.flatnonzero(weight)
        at, k = _find(w.hash, table)
        if not len(insults) and not (number[k] == 0).any():
            continue
        kinds = dict(zip(at.tolist(), number[k].tolist(), strict=True))
        clause_of = np.cumsum(_ENDS[w.raw])
        clauses: dict[tuple[int, int], list[tuple[int, str, float]]] = {}
        marked = np.union1d(insults, at)
        for n, text, clause in zip(marked.tolist(), w.text[marked].tolist(), clause_of[w.start[marked]].tolist(), strict=True):
            symbol, value = (INSULT, float(weight[n])) if weight[n] else (names[kinds[n]], 1.0)
            clauses.setdefault((text, clause), []).append((n, symbol, value))
        for (text, _), words in clauses.items():
            total = machine.clause(words)
            if total:
                out[text] += (total, 0.0, 1.0)
                out[text, 1] = max(out[text, 1], total)
    return out


def _inputs(x: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2])])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Ridge logistic regression by Newton's method."""
    a, b = _inputs(x), np.array(PLAIN)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        gradient = a.T @ (y - p) - 0.1 * b
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(4), gradient)
        b = b + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in b)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _arcs(counts: pd.DataFrame, toxic: int, other: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Significant features with their log odds, and the seeds."""
    arcs: dict[int, dict[int, float]] = {0: {wordhash.hash_of(w): SEED_WEIGHT for w in SEEDS}}
    if len(counts):
        odds = np.log((counts["toxic"] + 0.5) / (toxic + 1)) - np.log((counts["other"] + 0.5) / (other + 1))
        for size, h, w in zip(counts["size"], counts["h"], odds, strict=True):
            arcs.setdefault(int(size), {})[int(h) & 0xFFFFFFFFFFFFFFFF] = float(min(w, 8.0))
    return {s: (np.array(sorted(d), dtype=np.uint64), np.array([d[k] for k in sorted(d)])) for s, d in arcs.items() if d}


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn arcs and curve from at most ``fit_rows`` labelled rows that are not held out."""
    spark = docs.sparkSession
    ship(spark)
    shared_folder(spark)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    # The sample's ids and labels: at most fit_rows rows, and one text for each id.
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic").repartition(16).checkpoint()

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts: dict[int, list[np.ndarray]] = {}
            y = b["toxic"].to_numpy()
            for w in wordhash.blocks(list(b["text"])):
                for size in (0, *PREFIXES):
                    h = w.prefix(size) if size else w.hash
                    both = np.unique(np.rec.fromarrays([w.text[h != 0], h[h != 0]], names="t,h"))
                    parts.setdefault(size, []).append(both)
            for size, found in parts.items():
                every = np.concatenate(found)
                h, inverse = np.unique(every["h"], return_inverse=True)
                toxic = np.bincount(inverse, weights=y[every["t"]] > 0, minlength=len(h)).astype(np.int64)
                n = np.bincount(inverse, minlength=len(h)) - toxic
                yield pd.DataFrame({"size": np.full(len(h), size, dtype=np.int32), "h": h.view(np.int64), "toxic": toxic, "other": n})

    totals = sample.agg(F.coalesce(F.sum(F.when(F.col("toxic") > 0, 1)), F.lit(0)).alias("t"), F.count("*").alias("n")).first()
    toxic, other = int(totals["t"]), int(totals["n"]) - int(totals["t"])
    model = Model(_arcs(pd.DataFrame(), toxic, other))
    if not toxic or not other:
        return model
    counts = sample.mapInPandas(features, "size int, h long, toxic long, other long").groupBy("size", "h").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    share = toxic / (toxic + other)
    n = F.col("toxic") + F.col("other")
    term = lambda k, p: F.when(k > 0, k * F.log(k / (n * F.lit(p)))).otherwise(0.0)
    g2 = 2 * (term(F.col("toxic"), share) + term(F.col("other"), 1 - share))
    arcs = counts.where((F.col("toxic") / n > 0.8) & (F.col("toxic") >= 4)).withColumn("g2", g2).where(F.col("g2") >= MIN_G2).orderBy(F.desc("g2"), "size", "h").limit(MAX_ARCS).toPandas()
    model = Model(_arcs(arcs, toxic, other))

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series(list(evidence(list(texts), model, Machine(grammar()))))

    seen = sample.select(measure("text").alias("x"), "toxic").toPandas()  # three numbers for each row of the sample
    model.curve = _curve(np.stack(seen["x"].to_list()), (seen["toxic"] > 0).to_numpy().astype(float))
    return model


def score(docs: DataFrame, model: Model) -> Column:
    """A column with the score of ``text``."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # at most MAX_ARCS arcs

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = Machine(grammar())
        for texts in batches:
            z = _inputs(evidence(list(texts), shared.value, machine)) @ np.array(shared.value.curve)
            yield pd.Series(np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 9))
        tidy()

    return run(docs["text"])


def scored(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per input row: ``doc_id``, ``held_out``, ``score``, ``predicted``."""
    model = fit(docs, labels, fit_rows)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(docs, model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def clean(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The documents that are not rejected (score under 0.5), with their columns."""
    model = fit(docs, labels, fit_rows)
    return docs.where(score(docs, model) < 0.5)
