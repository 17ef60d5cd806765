"""FNV-1a with a splitmix64 finaliser, as Arrow-batched functions over numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of FNV-1a (64 bits) and of splitmix64.
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3
GOLDEN = 0x9E3779B97F4A7C15
MIX_1 = 0xBF58476D1CE4E5B9
MIX_2 = 0x94D049BB133111EB


def fnv1a(texts: list[bytes]) -> np.ndarray:
    """FNV-1a of each text, one byte position of all texts at a time."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    flat = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    h = np.full(len(texts), FNV_OFFSET, np.uint64)
    for i in range(int(lengths.max(initial=0))):
        live = np.flatnonzero(lengths > i)
        h[live] = (h[live] ^ flat[starts[live] + i]) * np.uint64(FNV_PRIME)
    return h


def splitmix(h: np.ndarray) -> np.ndarray:
    h = h + np.uint64(GOLDEN)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


def ring_hash(texts: list[bytes]) -> np.ndarray:
    return splitmix(fnv1a(texts))


def ring_points(nodes: list[str], copies: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the nodes' virtual copies, and the node (its position) of each."""
    names = list(dict.fromkeys(nodes))
    points = ring_hash([f"{n}#{i}".encode() for n in names for i in range(copies)])
    owner = np.repeat(np.arange(len(names)), copies)
    order = np.lexsort((owner, points))
    return points[order], owner[order]


def locate(keys: list[bytes], nodes: list[str], copies: int = 256) -> list[str]:
    """The node of each key: that of the first point at or after its hash, round the ring."""
    names = list(dict.fromkeys(nodes))
    points, owner = ring_points(names, copies)
    at = np.searchsorted(points, ring_hash(keys)) % len(points)
    return [names[i] for i in owner[at]]


def _bytes(keys: pd.Series) -> list[bytes]:
    return [k.encode() if k is not None else b"" for k in keys]


def ring_hash_hex(key: Column) -> Column:
    """16 hexadecimal digits of a key's ring hash."""

    @F.pandas_udf("string")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series([f"{h:016x}" for h in ring_hash(_bytes(keys)).tolist()])

    return run(key)


def ring_node(key: Column, nodes: list[str], copies: int = 256) -> Column:
    """The node that a consistent-hash ring of `nodes` gives a key to. The ring goes to each worker once."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        points, owner = ring_points(nodes, copies)
        names = np.array(list(dict.fromkeys(nodes)), object)
        for keys in batches:
            yield pd.Series(names[owner[np.searchsorted(points, ring_hash(_bytes(keys))) % len(points)]])

    return run(key)


def plain_shard(key: Column, n: int) -> Column:
    """FNV-1a modulo n, as unsigned numbers."""

    @F.pandas_udf("long")
    def run(keys: pd.Series) -> pd.Series:
        return pd.Series((fnv1a(_bytes(keys)) % np.uint64(n)).astype(np.int64))

    return run(key)


def sketch_cells(key: Column, rows: int = 4, width: int = 4096) -> Column:
    """The cell of a key in each row of a count-min sketch: hash of key and row number, modulo width."""

    @F.pandas_udf("array<int>")
    def run(keys: pd.Series) -> pd.Series:
        texts = _bytes(keys)
        cells = np.stack([ring_hash([t + bytes([r]) for t in texts]) % np.uint64(width) for r in range(rows)], axis=1).astype(int)
        return pd.Series(cells.tolist())

    return run(key)
