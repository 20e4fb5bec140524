"""Suffixes of a buffer in order, by two-stage sorting, with the common prefixes of neighbours.

A suffix is *small* if it comes before its successor (the suffix one byte later), else *large*. Stage one sorts only the
small ones, by eight bytes at a time, and again only where those tie. Stage two scans the buckets of first bytes upwards:
the place of a large suffix follows from that of its successor, which stands earlier, so each scanned bucket deals its
predecessors, in order, to the buckets of their own first bytes.
"""

from __future__ import annotations

import numpy as np

_LOW, _HIGH = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)


def words(padded: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, first byte highest, so that numbers compare as bytes do."""
    return np.ndarray((len(padded) - 7,), ">u8", padded, strides=(1,))


def small_suffixes(x: np.ndarray) -> np.ndarray:
    """For each place, whether its suffix comes before its successor. The empty suffix comes before all."""
    ends = np.append(np.flatnonzero(x[:-1] != x[1:]), len(x) - 1)
    rising = np.append(x[ends[:-1]] < x[ends[:-1] + 1], False)
    return np.repeat(rising, np.diff(ends, prepend=-1))


def direct_sort(word: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the ``depth`` bytes that follow; past a zero byte the order does not matter."""
    key = word[at].astype(np.uint64)
    order = np.argsort(key)
    at, key = at[order], key[order]
    place, group, off = np.arange(len(at)), np.zeros(len(at), np.int64), 0
    while True:
        first = np.ones(len(place), bool)
        first[1:] = (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(first) - 1
        ended = ((key - _LOW) & ~key & _HIGH) != 0
        tied = (np.bincount(group, minlength=1)[group] > 1) & ~ended
        place, group, off = place[tied], group[tied], off + 8
        if off >= depth or not len(place):
            return at
        here = at[place]
        key = word[here + off].astype(np.uint64)
        order = np.argsort(key)
        rank = np.empty(len(key), np.uint64)
        rank[order] = np.cumsum(np.append(0, key[order][1:] != key[order][:-1])).astype(np.uint64)
        order = np.argsort(group.astype(np.uint64) << np.uint64(32) | rank)  # groups keep their places
        at[place], key, group = here[order], key[order], group[order]


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """All places of ``x`` in the order of their suffixes, right for the first ``depth`` bytes or up to an end mark.

    ``x`` holds bytes above zero, and zeros as end marks; its last byte is an end mark.
    """
    word = words(np.concatenate([x, np.zeros(depth + 16, np.uint8)]))
    chosen = direct_sort(word, np.flatnonzero(small_suffixes(x) & (x > 0)), depth)
    cuts = np.searchsorted(x[chosen], np.arange(257))
    dealt: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in np.flatnonzero(np.bincount(x, minlength=256)):
        if c == 0:
            bucket = np.flatnonzero(x == 0)
        else:
            induced = dealt[c]
            ripple = np.concatenate(induced) if induced else np.empty(0, np.int64)
            zone = [ripple]
            while len(ripple):  # predecessors with the same byte follow inside the bucket
                ripple = ripple[ripple > 0] - 1
                ripple = ripple[x[ripple] == c]
                zone.append(ripple)
            bucket = np.concatenate([*zone, chosen[cuts[c] : cuts[c + 1]]])
            dealt[c] = []
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        byte = x[before]
        before, byte = before[byte > c], byte[byte > c]
        before = before[np.argsort(byte, kind="stable")]
        at = 0
        for d, n in enumerate(np.bincount(byte, minlength=1)):
            if n:
                dealt[d].append(before[at : at + n])
                at += n
    return np.concatenate(out) if out else np.empty(0, np.int64)


def common_prefixes(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """The number of equal leading bytes of each place in ``order`` and the next one, at most ``depth``."""
    word = words(np.concatenate([x, np.zeros(depth + 16, np.uint8)]))
    out = np.full(max(0, len(order) - 1), depth, np.int64)
    open_ = np.arange(len(out))
    for off in range(0, depth, 8):
        differ = word[order[open_] + off].astype(np.uint64) ^ word[order[open_ + 1] + off].astype(np.uint64)
        parted = differ != 0
        equal = sum((differ[parted] < np.uint64(1 << (8 * k))).astype(np.int64) for k in range(1, 8))
        out[open_[parted]] = np.minimum(depth, off + equal)
        open_ = open_[~parted]
    return out
