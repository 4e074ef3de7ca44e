"""Vectorised hashing of words and word windows, without an object for each word."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes hashed at once.
PIECE = 1 << 20
_tables: dict[tuple[int, bool], np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: int = _BASE, inverse: bool = False) -> np.ndarray:
    """``base ** 0 .. base ** (n-1)`` modulo 2**64, or of its inverse; kept for the next call."""
    table = _tables.get((base, inverse))
    if table is None or len(table) < n:
        b = pow(base, -1, 1 << 64) if inverse else base
        size = max(n, 1 << 12)
        table = np.ones(size, np.uint64)
        have = 1
        while have < size:
            more = min(have, size - have)
            table[have : have + more] = table[:more] * np.uint64(pow(b, have, 1 << 64))
            have += more
        _tables[base, inverse] = table
    return table[:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and how many words each text has.

    A word is a run of bytes other than space and \\t..\\r.
    """
    hashes, counts = [], np.zeros(len(texts), np.int64)
    at = 0
    while at < len(texts):
        size, end = 0, at
        while end < len(texts) and (end == at or size + len(texts[end]) < PIECE):
            size += len(texts[end]) + 1
            end += 1
        if end == at + 1 and size > 2 * PIECE:
            for piece in _cut(texts[at]):
                h, n = _hash_joined([piece])
                hashes.append(h)
                counts[at] += n[0]
        else:
            h, n = _hash_joined(texts[at:end])
            hashes.append(h)
            counts[at:end] = n
        at = end
    return np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), counts


def _cut(text: bytes) -> list[bytes]:
    """A very long text in pieces that end at white space."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and not _BLANK[text[end]]:
            end += 1
        out.append(text[at:end])
        at = end
    return out


def _hash_joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    blank = _BLANK[a]
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins)
    edges = np.cumsum([0, *[len(t) + 1 for t in texts]])
    at = np.searchsorted(starts, edges)
    if not len(starts):
        return np.zeros(0, np.uint64), np.diff(at)
    lengths = np.diff(starts, append=len(a))
    offset = np.arange(starts[0], len(a)) - np.repeat(starts, lengths)
    value = a[starts[0] :].astype(np.uint64) + np.uint64(1)
    value[blank[starts[0] :]] = 0
    value *= powers(int(lengths.max()))[offset]
    return mixed(np.add.reduceat(value, starts - starts[0])), np.diff(at)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    base = _BASE + 2 * size
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * powers(len(words), base), out=total[1:])
    return mixed((total[size:] - total[:-size]) * powers(n, base, True))


def sliding_min(x: np.ndarray, size: int) -> np.ndarray:
    """Least of every run of ``size`` values."""
    width = 1
    while width * 2 <= size:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    rest = size - width
    return np.minimum(x[:-rest], x[rest:]) if rest else x
