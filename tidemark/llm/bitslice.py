"""Bit-sliced comparison of fingerprints.

Fingerprints lie as bit planes: plane p has bit p of all of them, 64 to a word, so that one word operation works on 64
fingerprints. Distances are summed in carry-save counters (bit k of a counter is itself a plane), and words whose 64
distances all exceed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np

FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def to_planes(fps: np.ndarray) -> np.ndarray:
    """(n, bytes) uint8 to (bits, words) uint64; row i is bit i % 64 of word i // 64, and one spare word follows."""
    n = len(fps)
    rows = np.zeros(((n // 64 + 2) * 64, fps.shape[1]), np.uint8)
    rows[:n] = fps
    bits = np.unpackbits(rows, axis=1).T
    return np.packbits(np.ascontiguousarray(bits), axis=1, bitorder="little").view(np.uint64)


def add3(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save adder: (carry, sum) of three bits in each position."""
    u = a ^ b
    return (a & b) | (u & c), u ^ c


def exceeds(counters: list[np.ndarray], over: np.ndarray, radius: int) -> np.ndarray:
    """Where the counters' value is above the radius."""
    above, same = over, np.full_like(over, FULL)
    for k in range(len(counters) - 1, -1, -1):
        if radius >> k & 1:
            same = same & counters[k]
        else:
            above = above | (same & counters[k])
            same = same & ~counters[k]
    return above


def within(plane: Callable[[int, np.ndarray | None], np.ndarray], bits: int, size: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """plane(p, at) gives plane p of the differences, flat, for all words or those at `at`. Returns words that hold a
    difference of at most radius bits, and a mask of which of their 64 it is. bits is a multiple of 8."""
    depth = max(3, radius.bit_length())
    at = None
    counters = [np.zeros(size, np.uint64) for _ in range(depth)]
    over = np.zeros(size, np.uint64)
    for p in range(0, bits, 8):
        x = [plane(p + i, at) for i in range(8)]
        one, two, four = counters[:3]
        a, one = add3(one, x[0], x[1])
        b, one = add3(one, x[2], x[3])
        c, two = add3(two, a, b)
        a, one = add3(one, x[4], x[5])
        b, one = add3(one, x[6], x[7])
        d, two = add3(two, a, b)
        carry, four = add3(four, c, d)
        counters[:3] = one, two, four
        for k in range(3, depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p + 8 > radius and (p // 8 % 2 or p + 8 == bits):
            alive = np.flatnonzero(exceeds(counters, over, radius) != FULL)
            if not len(alive):
                return alive, np.zeros(0, np.uint64)
            if 2 * len(alive) < len(over):
                at = alive if at is None else at[alive]
                counters, over = [c[alive] for c in counters], over[alive]
    mask = ~exceeds(counters, over, radius)
    some = np.flatnonzero(mask)
    return (some if at is None else at[some]), mask[some]


def _pairs(words: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, bit) of each set bit."""
    bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    w, b = np.nonzero(bits)
    return words[w], b


def close_in_runs(fps: np.ndarray, run: np.ndarray, radius: int, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of equal run within the radius; rows are sorted by run and no run is longer than 64."""
    planes = to_planes(fps)
    size = planes.shape[1] - 1
    for lag in range(1, longest):
        same = np.zeros(size * 64, bool)
        same[: len(run) - lag] = run[lag:] == run[: len(run) - lag]
        if not same.any():
            break
        live = np.flatnonzero(same.reshape(-1, 64).any(axis=1))
        up, down = np.uint64(lag), np.uint64(64 - lag)

        def plane(p: int, at: np.ndarray | None, live=live, up=up, down=down) -> np.ndarray:
            w = live if at is None else live[at]
            here = planes[p, w]
            return here ^ ((here >> up) | (planes[p, w + 1] << down))

        words, mask = within(plane, planes.shape[0], len(live), radius)
        word, bit = _pairs(live[words], mask)
        i = word * 64 + bit
        i = i[same[i]]
        if len(i):
            yield i, i + lag


def close_to(queries: np.ndarray, fps: np.ndarray, radius: int, tile: int = 64) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, row) within the radius, a tile of queries against all rows at a time."""
    planes = to_planes(fps)[:, :-1]
    asked = np.where(np.unpackbits(queries, axis=1).T, FULL, np.uint64(0))
    size = planes.shape[1]
    for first in range(0, len(queries), tile):
        bits = asked[:, first : first + tile]

        def plane(p: int, at: np.ndarray | None, bits=bits) -> np.ndarray:
            if at is None:
                return (bits[p][:, None] ^ planes[p][None, :]).ravel()
            return bits[p][at // size] ^ planes[p][at % size]

        words, mask = within(plane, planes.shape[0], bits.shape[1] * size, radius)
        word, bit = _pairs(words, mask)
        q, i = word // size + first, word % size * 64 + bit
        keep = i < len(fps)
        yield q[keep], i[keep]


def distances(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[i] ^ fps[j]).sum(axis=1, dtype=np.int64)


def roots(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    p = parent[x]
    while True:
        q = parent[p]
        if np.array_equal(p, q):
            return p
        p = q


def shortest_forest(n: int, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Indices of the edges of a minimum spanning forest (Boruvka's rounds); ties by position."""
    parent = np.arange(n)
    rank = np.empty(len(d), np.int64)
    rank[np.argsort(d, kind="stable")] = np.arange(len(d))
    order = np.argsort(rank)
    chosen: list[np.ndarray] = []
    live = np.arange(len(d))
    while len(live):
        a, b = roots(parent, i[live]), roots(parent, j[live])
        apart = a != b
        live, a, b = live[apart], a[apart], b[apart]
        if not len(live):
            break
        best = np.full(n, len(d))
        np.minimum.at(best, a, rank[live])
        np.minimum.at(best, b, rank[live])
        pick = order[np.unique(best[best < len(d)])]
        chosen.append(pick)
        x, y = roots(parent, i[pick]), roots(parent, j[pick])
        while True:
            apart = x != y
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            x, y = roots(parent, x), roots(parent, y)
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)
