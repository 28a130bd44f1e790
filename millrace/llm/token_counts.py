"""Token counts: batch encoding in Arrow functions that return lengths only.

Texts are cut at ASCII white space where that is a safe boundary: for
tokenizers whose pre-tokenizer never lets a token span white space and whose
normalizer works on each side of it alone (``word_bpe``; see ``splits_at_space``), the count of a text
is the sum of the counts of its pieces.  For any other tokenizer texts stay whole.  Texts are taken in groups
of about equal bytes; the distinct pieces of a group are encoded in
batches balanced by bytes, lengths only are kept, in a
bounded memo, and summed by text.  So one very long text costs no more memory than its own size.

Cases: null and empty texts count zero bytes and zero tokens; repeated rows
each get their row; columns other than the id and the text are not read, so
clashing names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ship import ship, tidy

#: Bytes of text handed to the encoder at once.
BATCH_BYTES = 1 << 18
#: Characters of texts whose pieces are looked up together.
GROUP_BYTES = 1 << 20
#: Bytes of pieces that a worker remembers the counts of, each counted with ``ENTRY`` bytes more; the memo is emptied when full.
MEMO_BYTES = 48 << 20
ENTRY = 130


def byte_balanced(pieces: list[str], most: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Cut a list of strings into batches of at most ``most`` bytes (or one longer string)."""
    out: list[str] = []
    held = 0
    for p in pieces:
        n = len(p.encode("utf-8"))
        if out and held + n > most:
            yield out
            out, held = [], 0
        out.append(p)
        held += n
    if out:
        yield out


def splits_at_space(definition: str) -> bool:
    """Whether runs of ASCII white space are safe boundaries: no token spans them and nothing looks across them.

    True for lower-casing word tokenizers whose pattern takes no white space into words; everything else is encoded whole.
    """
    d = json.loads(definition)
    normal, pre = d.get("normalizer") or {}, d.get("pre_tokenizer") or {}
    steps = [x for x in normal.get("normalizers", [normal]) if x]
    plain = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"}) for x in steps)
    first = (pre.get("pretokenizers") or [pre])[0]
    pattern = (first.get("pattern") or {}).get("Regex", "")
    # What is left between matches of such a pattern is removed, white space with it.
    takes_words = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and r"\s" not in pattern.replace(r"[^\s", "[^") and " " not in pattern
    return plain and (takes_words or first.get("type") == "WhitespaceSplit") and not any(t.get("lstrip") or t.get("rstrip") or " " in t["content"] for t in d.get("added_tokens", []))


class Counter:
    """Counts tokens of texts; one per worker."""

    def __init__(self, definition: str, split_at_space: bool | None = None) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.split = splits_at_space(definition) if split_at_space is None else split_at_space
        self.memo: dict[str, int] = {"": 0}
        self.held = 0

    def _learn(self, pieces: set[str]) -> None:
        new = pieces - self.memo.keys()
        if self.held > MEMO_BYTES:
            self.memo = {"": 0}
            self.held, new = 0, pieces - {""}
        for batch in byte_balanced(list(new)):
            for p, e in zip(batch, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False), strict=True):
                self.memo[p] = len(e)
                self.held += ENTRY + len(p)

    def _pieces(self, text: str) -> list[str]:
        return text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if self.split else [text]

    def count(self, texts: list[str | None]) -> list[int]:
        """The counts of many texts: the distinct pieces of a group of about ``GROUP_BYTES`` are encoded together, then summed by text."""
        out: list[int] = []
        at = 0
        while at < len(texts):
            group: list[list[str]] = []
            held = 0
            while at < len(texts) and (not group or held < GROUP_BYTES):
                text = texts[at] or ""
                group.append(self._pieces(text))
                held += len(text)
                at += 1
            self._learn(set().union(*group))
            memo = self.memo
            out += [sum([memo[p] for p in pieces]) for pieces in group]
        return out


@functools.lru_cache(maxsize=1)
def counter_of(definition: str, split_at_space: bool | None) -> Counter:
    """The worker's counter: its memo lives on from task to task."""
    return Counter(definition, split_at_space)


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, split_at_space: bool | None = None) -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (``n_tokens > limit``)."""
    spark = docs.sparkSession
    ship(spark)
    # The definition is one file of fixed size (a few MB), so it can be broadcast at any input size.
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = counter_of(definition.value, split_at_space)
        for texts in batches:
            yield pd.Series(counter.count(list(texts)), dtype="int64")
        tidy()

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        n_tokens(text).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
