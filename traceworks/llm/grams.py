"""Hashes of words, word runs and byte runs, in numpy, over chunks of texts.

A chunk joins several texts (or holds one long text), so memory is bounded by ``CHUNK_BYTES`` or by the longest text.
Hashes are polynomials over random byte values modulo 2**64 with a mixing step; equal strings have equal hashes
wherever they stand. Nothing here crosses from one text into the next.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _BASE_INVERSE)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers[0], _powers[1]


def _prefix_sums(a: np.ndarray) -> np.ndarray:
    powers, _ = _power_tables(len(a) + 1)
    out = np.zeros(len(a) + 1, np.uint64)
    np.cumsum(_BYTES[a] * powers[: len(a)], out=out[1:])
    return out


def chunked(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together stay below ``CHUNK_BYTES``, or single longer ones."""
    first = size = 0
    for i, text in enumerate(texts):
        if i > first and size + len(text) > CHUNK_BYTES:
            yield first, i
            first, size = i, 0
        size += len(text) + 1
    if first < len(texts):
        yield first, len(texts)


@dataclass
class Words:
    """The words of a chunk: their hashes, byte spans in ``raw``, and the text (0, 1, ..) each belongs to.

    ``first[t] : first[t + 1]`` are the words of text ``t``.
    """

    raw: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text: np.ndarray
    first: np.ndarray

    def within(self, width: int) -> np.ndarray:
        """For each run of ``width`` words, whether it lies in one text."""
        n = len(self.text) - width + 1
        return self.text[:n] == self.text[width - 1 :] if n > 0 else np.zeros(0, bool)


def words(texts: list[bytes]) -> Words:
    raw = b"\n".join(texts)
    a = np.frombuffer(raw, np.uint8)
    space = np.ones(len(a) + 2, np.int8)
    space[1:-1] = (a == 32) | ((a >= 9) & (a <= 13))
    step = np.diff(space)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    sums = _prefix_sums(a)
    _, inverse = _power_tables(len(a) + 1)
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    edges = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=edges[1:])
    first = np.searchsorted(starts, edges)
    return Words(raw, hashes, starts, ends, np.repeat(np.arange(len(texts)), np.diff(first)), first)


def byte_grams(a: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` bytes."""
    n = len(a) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    sums = _prefix_sums(a)
    _, inverse = _power_tables(len(a) + 1)
    return mix((sums[k:] - sums[:n]) * inverse[:n])


def runs(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of ``k`` consecutive hashes."""
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out *= _U(0xD6E8FEB86659FD93)
        out += h[j : j + n]
    return mix(out)


def lowest(g: np.ndarray, w: int) -> np.ndarray:
    """For each window of ``w`` consecutive hashes, the position of the lowest one (upper 32 bits, leftmost on ties)."""
    n = len(g) - w + 1
    if n < 1:
        return np.zeros(0, np.int64)
    rows = -(-len(g) // w)
    grid = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(g)] = (g & _U(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    grid = grid.reshape(rows, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _U(0xFFFFFFFF)).astype(np.int64)


def covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Mask of the ``n`` places that runs of ``lengths`` places from ``starts`` cover."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.minimum(starts, n), 1)
    np.add.at(step, np.minimum(starts + lengths, n), -1)
    return np.cumsum(step[:-1]) > 0
