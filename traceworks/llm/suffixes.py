"""Suffix arrays and common prefixes of one shard of bytes, in numpy."""

from __future__ import annotations

import numpy as np


def _eights(a: np.ndarray) -> np.ndarray:
    """Eight bytes from every place on as one number, the first byte highest, zeros past the end."""
    padded = np.zeros(len(a) + 8, np.uint64)
    padded[: len(a)] = a
    key = padded[: len(a)].copy()
    for j in range(1, 8):
        key <<= np.uint64(8)
        key |= padded[j : j + len(a)]
    return key


def suffix_array(a: np.ndarray, depth: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all suffixes of ``a`` in byte order, by Larsson-Sadakane refinement, and which of them are ``tied``.

    Suffixes are sorted by eight bytes, then only the groups still equal are sorted again by the rank of the suffix
    ``h`` bytes further on, with ``h`` doubling each time. A place of the array is tied if its suffix was still equal
    to the one before it when ``depth`` bytes (8, 16, 32, ..) had been looked at.
    """
    n = len(a)
    tied = np.zeros(n, bool)
    if n == 0:
        return np.zeros(0, np.int64), tied
    key = _eights(a)
    sa = np.argsort(key)
    sorted_key = key[sa]
    head = np.ones(n, bool)
    head[1:] = sorted_key[1:] != sorted_key[:-1]
    del key, sorted_key
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    # Places in the array whose group has more than one suffix.
    open_ = np.flatnonzero(~(head & np.append(head[1:], True)))
    h = 8
    while len(open_):
        if h == depth:
            ranks = rank[sa]
            tied[1:] = ranks[1:] == ranks[:-1]
        suffix = sa[open_]
        ahead = suffix + h
        # Past the end the shorter suffix comes first.
        then = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], n - 1 - ahead) + n
        pair = (rank[suffix] << 32) | then
        order = np.argsort(pair)
        suffix, pair = suffix[order], pair[order]
        sa[open_] = suffix
        new = np.ones(len(open_), bool)
        new[1:] = pair[1:] != pair[:-1]
        rank[suffix] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, tied


def common_prefixes(a: np.ndarray, sa: np.ndarray, tied: np.ndarray, depth: int, most: int,
                    lane: int = 256) -> np.ndarray:
    """Bytes, ``most`` at the most, that each tied suffix of ``sa`` shares with the one before it; 0 for the others.

    Suffixes that are not tied share fewer than ``depth`` bytes. Kasai's pass over the text, run in lanes of ``lane``
    consecutive positions side by side: within a lane a position starts from the length of the one before it, less
    one, or from ``depth``, and goes on eight bytes at a time.
    """
    n = len(a)
    if n < 2:
        return np.zeros(n, np.int64)
    before = np.full(n, -1, np.int64)
    at = np.flatnonzero(tied)
    before[sa[at]] = sa[at - 1]
    plcp = np.zeros(n, np.int64)
    eights, padded = np.append(_eights(a), np.uint64(0)), np.append(a, np.zeros(1, np.uint8))
    carried = np.zeros(-(-n // lane), np.int64)
    for offset in range(lane):
        place = np.arange(offset, n, lane)
        other = before[place]
        row = np.flatnonzero(other >= 0)
        place, other = place[row], other[row]
        carried_on = carried[row]
        carried[:] = 0
        room = np.minimum(most, n - np.maximum(place, other))
        length = np.minimum(np.maximum(carried_on, depth), room)
        for step, source in ((8, eights), (1, padded)):
            go = np.arange(len(row))
            while len(go):
                i, j = place[go] + length[go], other[go] + length[go]
                fits = length[go] + step <= room[go]
                go = go[fits & (source[np.minimum(i, n)] == source[np.minimum(j, n)])]
                length[go] += step
        plcp[place] = length
        carried[row] = np.maximum(length - 1, 0)
    return plcp[sa]
