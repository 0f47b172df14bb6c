"""Vectorised words and hashes over Arrow text columns.

A word is a maximal run of bytes other than space and 0x09-0x0D, which in UTF-8 is the regular expression
``[^\\x20\\x09-\\x0D]+`` on characters. The distinct words of a slice are found by an exact dictionary and each gets a keyed
128-bit BLAKE2 digest, of which ``hash`` and ``other`` are the halves; so no choice of words makes two of them equal. Hashes of
word n-grams are made by doubling: that of 2k words mixes those of its halves, and a mixing step isn't linear, so no arrangement
of two words (as with polynomial hashes) makes n-grams collide either.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from xxhash import xxh3_128_digest

U = np.uint64
SLICE = 1 << 20
#: At most 16 bytes.
KEY = b"sievelight words"
SEP = np.zeros(256, bool)
SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
PUNCT = np.zeros(256, bool)
PUNCT[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_rng = np.random.default_rng(20240229)
C1, C2 = (int(x) | 1 for x in _rng.integers(2**61, 2**63, 2, dtype=np.uint64))
MASK = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U(32))
    h = h * U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    h *= U(0xD6E8FEB86659FD93)
    h ^= h >> U(32)
    return h


@dataclass
class Words:
    """The words of some consecutive rows of a column.

    ``first[r]`` to ``first[r + 1]`` are the words of row ``row0 + r``; ``start`` and ``end`` are byte offsets in ``data``.
    """

    row0: int
    data: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray
    other: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.first) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.first))

    def text(self, lo: int, hi: int) -> list[str]:
        return [self.data[s:e].tobytes().decode("utf-8", "replace") for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True)]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null counts as empty."""
    if pa.types.is_binary(column.type):
        column = column.fill_null(b"").cast(pa.large_binary())
    else:
        column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets


def word_digests(solid: np.ndarray, lengths: np.ndarray, key: bytes | None = KEY) -> np.ndarray:
    """Both halves of the keyed digest of each word: ``solid`` has the words' bytes without separators. Shape (words, 2).

    Without a key it's XXH3, which is faster and has no collisions by chance either, but doesn't withstand words made to collide.
    """
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    array = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(solid))])
    coded = array.dictionary_encode()
    names = coded.dictionary.to_pylist()
    digests = b"".join(list(map(xxh3_128_digest, names)) if key is None else [blake2b(w, digest_size=16, salt=key).digest() for w in names])
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)[coded.indices.to_numpy()]


def words(column: pa.Array, lower: bool = False, key: bytes | None = KEY, trim: bool = False) -> Iterator[Words]:
    """Words with both hashes, in slices of whole rows of about ``SLICE`` bytes; with ``trim`` without ASCII punctuation at their ends."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    n, r = len(column), 0
    while r < n:
        to = max(r + 1, int(np.searchsorted(offsets, offsets[r] + SLICE, "right")) - 1)
        to = min(to, n)
        raw = data[offsets[r] : offsets[to]]
        part = LOWER[raw] if lower else raw
        bounds = offsets[r : to + 1] - offsets[r]
        solid = ~SEP[part]
        edge = np.zeros(len(part) + 1, bool)
        edge[bounds] = True
        before = np.empty(len(part), bool)
        after = np.empty(len(part), bool)
        if len(part):
            before[0], after[-1] = True, True
            before[1:] = ~solid[:-1]
            after[:-1] = ~solid[1:]
            before |= edge[:-1]
            after |= edge[1:]
        start = np.flatnonzero(solid & before)
        end = np.flatnonzero(solid & after) + 1
        if trim and len(start):
            inner = ~PUNCT[part]
            at = np.arange(len(part))
            first = np.minimum.accumulate(np.where(inner, at, len(part))[::-1])[::-1]
            last = np.maximum.accumulate(np.where(inner, at, -1))
            start, end = first[start], last[end - 1] + 1
            some = start < end
            start, end = start[some], end[some]
            edges = np.zeros(len(part) + 1, np.int8)
            edges[start] += 1
            edges[end] -= 1
            solid = np.cumsum(edges[:-1], dtype=np.int8).view(bool)
        h = word_digests(part[solid], end - start, key)
        yield Words(r, part, bounds, start, end, np.searchsorted(start, bounds), np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]))
        r = to


class Grams:
    """Hashes of word n-grams of any length, from those of 1, 2, 4, 8 ... words, which are made when first asked for."""

    def __init__(self, h: np.ndarray):
        self.n = len(h)
        self.levels = [h]

    def _level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            low, half = self.levels[-1], 1 << (len(self.levels) - 1)
            size = max(0, len(low) - half)
            self.levels.append(mix(low[:size] * U(C1) + low[half : half + size]))
        return self.levels[k]

    def of(self, start: np.ndarray, length) -> np.ndarray:
        if np.isscalar(length):
            out, at = np.full(len(start), int(length) * C2 & MASK, np.uint64), start
            for k in reversed(range(int(length).bit_length())):
                if int(length) >> k & 1:
                    out = mix(out * U(C1) + self._level(k)[at])
                    at = at + (1 << k)
            return out
        length = np.asarray(length, np.int64)
        out, at = length.astype(np.uint64) * U(C2), np.array(start, np.int64)
        for k in reversed(range(int(length.max()).bit_length() if len(length) else 0)):
            on = np.flatnonzero(length >> k & 1)
            out[on] = mix(out[on] * U(C1) + self._level(k)[at[on]])
            at[on] += 1 << k
        return out


def gram_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the k-word grams inside rows, and how many each row has."""
    per = np.maximum(np.diff(first) - (k - 1), 0)
    total = int(per.sum())
    skip = np.repeat(first[:-1] - (np.cumsum(per) - per), per)
    return np.arange(total) + skip, per
