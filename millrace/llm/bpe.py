"""Byte-level BPE: encoding by a traversal of a prefix-sharing trie, and decoding.

The BPE encoding of a string can be read off its prefixes: for every prefix
there is exactly one token that ends the prefix's encoding, and it is the
only vocabulary token that is a suffix of the prefix and that may follow the
token that ends the shorter prefix before it.  Words are therefore inserted
into a trie (a sorted list of distinct words *is* the depth-first order of
that trie) and the last-token state of each prefix is computed once, however
many words share it.  A word's encoding is read backwards from its last state.

Whether token ``b`` may follow token ``a`` is decided by undoing merges around
the cut between them: the pair is allowed iff no merge that BPE would have
applied earlier than the ones that formed ``a`` and ``b`` crosses the cut.

Cases: null and empty texts encode to no ids and decode to the empty string;
special strings inside a text become their special id, as the library does by
default; repeated rows each get their row; an empty table gives an empty
result; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.ship import ship, tidy

#: Fixed value: the published pre-tokenization pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of words and encodings that a task remembers, each counted with ``ENTRY`` bytes more; the memo is emptied when full.
MEMO_BYTES = 64 << 20
ENTRY = 180
#: Texts of about so many characters are pre-tokenized together.
GROUP_CHARS = 1 << 19


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(rest)}


class Vocabulary:
    """Tokens as bytes, merges as a pair table, and the split of each merged token."""

    def __init__(self, definition: str) -> None:
        d = json.loads(definition)
        model = d["model"]
        symbols = byte_symbols()
        raw = {s: bytes(symbols[c] for c in s) for s in model["vocab"]}
        self.ids: dict[bytes, int] = {raw[s]: i for s, i in model["vocab"].items()}
        self.special: dict[str, int] = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        self.bytes_of: dict[int, bytes] = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.pairs: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.ids.values(), -1)
        self.parts: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(model["merges"]):
            left, right = model["vocab"][a], model["vocab"][b]
            made = model["vocab"][a + b]
            self.pairs[left, right] = r
            if made not in self.parts:
                self.parts[made] = (left, right)
                self.rank[made] = r
        self.longest = max(map(len, self.ids))
        self.allowed: dict[int, bool] = {}

    def may_follow(self, pair: int) -> bool:
        """True iff BPE can leave the tokens ``pair >> 20`` and ``pair & 0xFFFFF`` side by side."""
        if len(self.allowed) > 200_000:
            self.allowed.clear()
        out = self.allowed[pair] = self._unmerge(pair >> 20, pair & 0xFFFFF)
        return out

    def _unmerge(self, left: int, right: int) -> bool:
        # ``bound``: merges of this rank or later had not happened when the current pair stood at the cut.
        bound = len(self.pairs)
        last_left = False
        while True:
            crossing = self.pairs.get((left, right))
            # At equal ranks the occurrence further left is merged first: undoing
            # the left token's merge leaves a crossing pair of the same rank to its right.
            if crossing is not None and (crossing < bound or (crossing == bound and not last_left)):
                return False
            rl, rr = self.rank[left], self.rank[right]
            if rl < 0 and rr < 0:
                return True
            # Undo the later merge; at equal ranks the right one came second.
            if rl > rr:
                bound, last_left, left = rl, True, self.parts[left][1]
            else:
                bound, last_left, right = rr, False, self.parts[right][0]


def _check(d: dict) -> None:
    """Refuse definitions whose steps are not the ones done here."""
    pre = d.get("pre_tokenizer") or {}
    model = d["model"]
    odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
    if model.get("type", "BPE") != "BPE" or d.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or odd or model.get("ignore_merges"):
        raise ValueError("only plain byte-level BPE with the usual pattern is supported")


class Encoder:
    """Encodes distinct words once; keeps packed ids by word."""

    def __init__(self, definition: str) -> None:
        self.vocab = Vocabulary(definition)
        _check(json.loads(definition))
        self.words = regex.compile(PATTERN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocab.special, key=len, reverse=True))) + ")") if self.vocab.special else None
        self.memo: dict[str, bytes] = {}
        self.held = 0

    def learn(self, words: set[str]) -> None:
        """Depth-first walk over the trie of the new words."""
        new = words - self.memo.keys()
        if self.held > MEMO_BYTES:
            self.memo.clear()
            self.held, new = 0, words
        find, longest = self.vocab.ids.get, self.vocab.longest
        known, ask = self.vocab.allowed.get, self.vocab.may_follow
        before = b""
        state: list[tuple[int, int]] = [(-1, 0)]  # for each prefix: its last token and where that token starts
        for word in sorted(new):  # the order of code points is the order of their UTF-8
            raw = word.encode("utf-8")
            shared, top = 0, min(len(raw), len(before))
            while shared < top and raw[shared] == before[shared]:
                shared += 1
            del state[shared + 1 :]
            for end in range(shared + 1, len(raw) + 1):
                # Only one token fits, so the order is free; short ones are the likelier.
                for start in range(end - 1, max(0, end - longest) - 1, -1):
                    token = find(raw[start:end])
                    if token is None:
                        continue
                    if start:
                        pair = state[start][0] << 20 | token
                        fits = known(pair)
                        if fits is None:
                            fits = ask(pair)
                        if not fits:
                            continue
                    state.append((token, start))
                    break
                else:
                    raise ValueError("the vocabulary does not cover all bytes")
            out: list[int] = []
            end = len(raw)
            while end:
                token, end = state[end]
                out.append(token)
            self.memo[word] = struct.pack(f"<{len(out)}I", *out[::-1])
            self.held += ENTRY + len(raw) + 4 * len(out)
            before = raw

    def _split(self, text: str) -> list[str]:
        """The text's words; a special string stands as itself."""
        if self.special is None or not any(s in text for s in self.vocab.special):
            return self.words.findall(text)
        out: list[str] = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else self.words.findall(part)
        return out

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Packed little-endian ids of each text."""
        at = 0
        while at < len(texts):
            group: list[list[str]] = []
            held = 0
            while at < len(texts) and (not group or held < GROUP_CHARS):
                group.append(self._split(texts[at] or ""))
                held += len(texts[at] or "")
                at += 1
            self.learn({w for words in group for w in words} - self.vocab.special.keys())
            for name, i in self.vocab.special.items():  # the memo may have been emptied
                self.memo[name] = np.array([i], dtype="<u4").tobytes()
            memo = self.memo
            for words in group:
                yield b"".join([memo[w] for w in words])

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that are no UTF-8 become replacement characters."""
        table = self.vocab.bytes_of
        return b"".join([table[i] for i in np.frombuffer(packed, dtype="<u4").tolist()]).decode("utf-8", errors="replace")


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``, and with ``with_ids`` also ``ids`` and ``decoded``."""
    spark = docs.sparkSession
    ship(spark)
    # One vocabulary file of fixed size (a few MB): safe to broadcast at any input size.
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else "")

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(definition.value)
        for texts in batches:
            rows = []
            for packed in encoder.encode_many(list(texts)):
                decoded = encoder.decode(packed)
                row = (len(packed) // 4, hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                rows.append((*row, np.frombuffer(packed, dtype="<i4"), decoded) if with_ids else row)
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_ids else [])])
        # Workers outlive their task and wait beside those that run: none keeps a vocabulary and a memo.
        encoder = None
        tidy()

    return docs.select(F.col(id_col).alias("doc_id"), run(F.col(text_col)).alias("r")).select("doc_id", "r.*")
