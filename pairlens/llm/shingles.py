"""Words and shingles of whole texts as 64-bit hashes, for a batch of texts at a time.

Words are runs of bytes other than space and 0x09-0x0D, with A-Z lowered. The
hash of a word is a polynomial over its bytes modulo 2**64, read off prefix
sums, so that no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_STEP = np.uint64(0xD1B54A32D192ED03)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_POWERS: dict[str, np.ndarray] = {}
#: Bytes whose prefix sums are held at once.
CHUNK = 1 << 17


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of each."""
    if "up" not in _POWERS or len(_POWERS["up"]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string or binary array, and the n + 1 offsets."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


@dataclass
class Words:
    """hashes of all words of a batch in order; ``bounds[i]:bounds[i + 1]`` are those of text i."""

    hashes: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]


def words(column: pa.Array) -> Words:
    data, offsets = text_bytes(column)
    if not len(data):
        return Words(np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    letters = ~_IS_BLANK[data]
    first = letters.copy()
    first[1:] &= ~letters[:-1]
    last = letters.copy()
    last[:-1] &= ~letters[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = letters[inner]  # a word ends with its text
    last[inner - 1] = letters[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + CHUNK, CHUNK))
    for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if low < high:
            base = starts[low]
            part = _LOWER[data[base : ends[high - 1]]].astype(np.uint64) + np.uint64(1)
            up, down = _powers(len(part))
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            own = starts[low:high] - base
            hashes[low:high] = mix((sums[ends[low:high] - base] - sums[own]) * down[own])
    return Words(hashes, np.searchsorted(starts, offsets))


def slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, pa.Array]]:
    """(first row, part) of an array of texts, in parts of about ``most_bytes``; a longer text is a part of its own."""
    column = column.cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else []
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most_bytes, "right")) - 1)
        yield low, column.slice(low, high - low)
        low = high


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(hashes) - n + 1, np.uint64(n), np.uint64)
    for j in range(n):
        out = out * _STEP + hashes[j : len(hashes) - n + 1 + j]
    return mix(out)


def shingle_list(hashes: np.ndarray, n: int = 5) -> np.ndarray:
    """Shingles in order, with repeats; of fewer than n words the whole sequence as one, of none nothing."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    return ngrams(hashes, min(n, len(hashes)))
