"""Vectorised hashes of words and byte strings, the same in every task and on every machine."""

from __future__ import annotations

import hashlib

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_tables: dict[int, np.ndarray] = {}

#: ASCII white space, 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of more bytes are hashed with BLAKE2.
LONG_WORD = 256
#: Lower case for A-Z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(base: np.uint64, n: int) -> np.ndarray:
    have = _tables.get(int(base))
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, np.uint64)
        step[0] = 1
        have = _tables[int(base)] = np.cumprod(step)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a hash over all 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Prefix:
    """Polynomial prefix sums of a byte array; hashes of any of its substrings from them."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=self.sums[1:])
        self.inverse = _powers(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))

    def all_of(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes that start at each position."""
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document index of the words (runs of other than ``separator`` bytes) of documents laid end to end."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray, chunk: int = 4_000_000, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the (lower-cased) words of documents laid end to end, and each word's document.

    A document longer than ``chunk`` is worked through in parts that end at white space. Words of over LONG_WORD bytes, for
    which unequal ones of the same polynomial are known, have the BLAKE2 hash of their bytes.
    """
    starts, ends, owner = word_spans(data, offsets)
    if lower:
        data = LOWER[data]
    hashes = _polynomials(data, starts, ends, chunk)
    for j in np.flatnonzero(ends - starts > LONG_WORD):
        hashes[j] = np.frombuffer(hashlib.blake2b(data[starts[j] : ends[j]], digest_size=8).digest(), "<u8")[0]
    return hashes, owner


def _polynomials(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, chunk: int) -> np.ndarray:
    if len(data) <= chunk:
        return Prefix(data).of(starts, ends)
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + chunk, "right")))
        low = starts[i]
        out.append(Prefix(data[low : ends[j - 1]]).of(starts[i:j] - low, ends[i:j] - low))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``width`` consecutive words of one document, and their documents.

    A document with some words, but fewer than ``width``, has one: its whole sequence.
    """
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    m = max(0, n - width + 1)
    whole = owner[width - 1 :] == owner[:m]
    total = np.zeros(m, np.uint64)
    for k in range(width):
        total += words[k : k + m] * factor[k]
    out, who = mix(total[whole]), owner[:m][whole]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    count = np.diff(np.concatenate([first, [n]]))
    extra, names = [], []
    for f, c in zip(first[count < width], count[count < width]):
        extra.append(np.add.reduce(words[f : f + c] * factor[:c]) + np.uint64(c))
        names.append(owner[f])
    if extra:
        out, who = np.concatenate([out, mix(np.array(extra, np.uint64))]), np.concatenate([who, np.array(names, who.dtype)])
    return out, who


def distinct_pairs(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values of each owner, by owner, then value."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], owner[keep]
