"""Words of many texts as arrays of 64-bit hashes, without a loop over words.

A *word* is a maximal run of ASCII letters, digits and ``_`` or of characters
outside ASCII.  Upper case is folded for ASCII and for Latin-1 letters, so
places stay the same.  Texts are handled in blocks of about ``BLOCK_BYTES``,
and a longer text is cut into blocks between words, so working memory is
bounded; a whole text costs eight bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

BLOCK_BYTES = 1 << 18

_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_TABLES: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        n = BLOCK_BYTES + 64
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _TABLES["power"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(_BASE))]), dtype=np.uint64)
            _TABLES["back"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, np.uint64(inverse))]), dtype=np.uint64)
        fold = np.arange(256, dtype=np.uint8)
        fold[65:91] += 32
        word = np.zeros(256, dtype=bool)
        word[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True
        _TABLES["fold"], _TABLES["word"] = fold, word
    return _TABLES


@dataclass
class Words:
    """Words of one block: hash, byte places in ``raw``, and the number of the text."""

    raw: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    run: np.ndarray | None = None  # running hash by byte
    before: np.ndarray | None = None  # its value where each word starts

    def prefix(self, size: int) -> np.ndarray:
        """Hash of the first ``size`` bytes of each word, 0 where the word is not longer."""
        long = np.flatnonzero(self.end - self.start > size)
        out = np.zeros(len(self.start), np.uint64)
        at = self.start[long]
        with np.errstate(over="ignore"):
            out[long] = mix((self.run[at + size - 1] - self.before[long]) * _tables()["back"][at]) + np.uint64(size)
        return out


def _block(raw: np.ndarray, text_ends: np.ndarray, first_text: int) -> Words:
    t = _tables()
    low = t["fold"][raw]
    if len(raw) > 1:
        c3 = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low[1:][c3] += 32
    inside = t["word"][raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    start, end = edge[::2], edge[1::2]
    run = before = np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        run = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * t["power"][: len(raw)], dtype=np.uint64)
        before = np.where(start > 0, run[start - 1], np.uint64(0)) if len(start) else np.zeros(0, np.uint64)
        hashes = mix((run[end - 1] - before) * t["back"][start]) if len(start) else np.zeros(0, np.uint64)
    return Words(raw, hashes, start, end, first_text + np.searchsorted(text_ends, start, side="right"), run, before)


def _cut(raw: bytes) -> Iterator[bytes]:
    """A long text in parts of at most a block, cut between words where there is a gap."""
    at = 0
    while len(raw) - at > BLOCK_BYTES:
        to = at + BLOCK_BYTES
        window = np.frombuffer(raw, dtype=np.uint8)[to - 65536 : to]
        gaps = np.flatnonzero(~_tables()["word"][window])
        to = to - 65536 + int(gaps[-1]) + 1 if len(gaps) else to
        yield raw[at:to]
        at = to
    yield raw[at:]


def blocks(texts: list[str | None]) -> Iterator[Words]:
    """The words of all texts in order; a long text spans several blocks."""
    held: list[bytes] = []
    size = first = 0
    for n, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) + 1 > BLOCK_BYTES:
            if held:
                yield _joined(held, first)
            for part in _cut(raw):
                yield _block(np.frombuffer(part, dtype=np.uint8), np.array([len(part) + 1]), n)
            held, size, first = [], 0, n + 1
            continue
        if size + len(raw) + 1 > BLOCK_BYTES:
            yield _joined(held, first)
            held, size, first = [], 0, n
        held.append(raw)
        size += len(raw) + 1
    if held:
        yield _joined(held, first)


def _joined(held: list[bytes], first: int) -> Words:
    ends = np.cumsum([len(r) + 1 for r in held])
    return _block(np.frombuffer(b"\n".join(held) + b"\n", dtype=np.uint8), ends, first)


def grouped(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Whole texts, some at a time: (hashes, cuts, first text, end): text ``first + k`` has ``hashes[cuts[k]:cuts[k+1]]``."""
    pending: list[Words] = []
    done = 0

    def out(upto: int) -> tuple[np.ndarray, np.ndarray, int, int]:
        h = np.concatenate([w.hash for w in pending]) if pending else np.zeros(0, np.uint64)
        t = np.concatenate([w.text for w in pending]) if pending else np.zeros(0, np.int64)
        return h, np.searchsorted(t, np.arange(done, upto + 1)), done, upto

    words = blocks(texts)
    ahead = next(words, None)
    while ahead is not None:
        now, ahead = ahead, next(words, None)
        pending.append(now)
        # Texts without words have no entry; a text goes on in the next block only if that starts with it.
        upto = len(texts) if ahead is None else int(ahead.text[0]) if len(ahead.text) else None
        if upto is None:
            continue
        if ahead is not None and len(now.text) and upto == int(now.text[-1]):
            if upto > done:
                keep = [Words(w.raw, w.hash[w.text >= upto], w.start, w.end, w.text[w.text >= upto]) for w in pending]
                pending = [Words(w.raw, w.hash[w.text < upto], w.start, w.end, w.text[w.text < upto]) for w in pending]
                yield out(upto)
                pending, done = keep, upto
            continue
        yield out(upto)
        pending, done = [], upto
    if done < len(texts):
        yield out(len(texts))


def windows(hashes: np.ndarray, cuts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word windows and the number of windows of each text; a text of 1 to k-1 words has one window, all its words."""
    n = np.diff(cuts)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    with np.errstate(over="ignore"):
        padded = np.concatenate([hashes, np.zeros(k, np.uint64)])
        acc = np.zeros(len(hashes), dtype=np.uint64)
        for j in range(k):
            acc = acc * np.uint64(0x9E3779B97F4A7C15) + padded[j : j + len(hashes)]
    first = np.repeat(cuts[:-1], count) + _within(count)
    out = acc[first] if len(first) else np.zeros(0, np.uint64)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        place = np.cumsum(count) - count
        for t in short:
            h = np.uint64(0)
            with np.errstate(over="ignore"):
                for w in hashes[cuts[t] : cuts[t + 1]]:
                    h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
            out[place[t]] = h + np.uint64(n[t])
    return mix(out), count


def _within(count: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, in a row."""
    total = int(count.sum())
    return np.arange(total) - np.repeat(np.cumsum(count) - count, count)


def hash_of(word: str) -> int:
    """The hash of one word, as it has in texts."""
    w = next(blocks([word]))
    return int(w.hash[0]) if len(w.hash) == 1 else 0
