"""PII: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are ``email``, ``ip``, ``card`` (Luhn) and ``phone``; the method
adds ``iban`` (mod 97).  Each confirmed span gets a score: the kind's own
prior plus a bonus when a context word of the kind stands within
``CONTEXT_CHARS`` characters before it.  Scores never remove a span.

Scanning is linear in the text: e-mails are found from their ``@`` outwards,
addresses and cards start only where no digit precedes, which gives the same
leftmost, non-overlapping matches as the plain patterns.

Cases: null and empty texts give zero counts and an empty span list; spans
are in code points, end exclusive; spans that start together are ordered by
kind as listed in ``KINDS``; repeated rows each get their row; whole texts of
any length are scanned; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.ship import ship

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]
CONTEXT_CHARS = 40

# Context words and priors by kind.
CONTEXT = {
    "email": ("mail", "e-mail", "email", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login", "adresse", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.7, "phone": 0.5, "iban": 0.8}
BONUS = 0.2

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){13}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """The Luhn checksum of a string of digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if k % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The mod-97 check of an IBAN without spaces."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free = 0  # end of the match before
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        # What was walked over before an "@" that doesn't match can't be part of a later local part: "@" is none of its characters.
        at = text.find("@", m.end() if m else at + 1)


def find(text: str | None) -> list[tuple[int, int, str]]:
    """All confirmed spans as (start, end, kind), by start, then kind as listed."""
    if not text:
        return []
    out: list[tuple[int, int, str]] = [(s, e, "email") for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    if _LONG_CARD.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                out.append((m.start(), m.end(), "phone"))
    for m in _IBAN.finditer(text):
        whole = m[0].replace(" ", "")
        if 15 <= len(whole) <= 34 and mod97(whole):
            out.append((m.start(), m.end(), "iban"))
    order = {k: n for n, k in enumerate(KINDS)}
    return sorted(out, key=lambda x: (x[0], order[x[2]], x[1]))


def score(text: str, start: int, kind: str) -> float:
    """The kind's prior, raised when one of its context words stands before the span."""
    near = {w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT_CHARS) : start])}
    return round(PRIOR[kind] + BONUS * bool(near & set(CONTEXT[kind])), 6)


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and ``spans`` (array of kind, start, end, score)."""
    ship(docs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": s, "end": e, "score": score(t, s, k)} for s, e, k in find(t)] for t in texts], dtype=object)

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("spans"))


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of ``scan``'s result."""
    s = F.col("spans")
    shown = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter(s, lambda x: x["kind"].isin(*BASE))
    return scanned.select(
        "doc_id",
        *[F.size(F.filter(s, _of_kind(k))).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"),
        shown(s).alias("spans"),
        F.coalesce(F.round(F.aggregate(s, F.lit(0.0), lambda a, x: F.greatest(a, x["score"])), 6), F.lit(0.0)).alias("max_score"),
    )

