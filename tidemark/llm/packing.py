"""Hierarchical multi-length packing of documents into windows of several context sizes.

Each task packs the documents of its partition in one pass. Whole longest windows are cut from long documents; what is
left of a document goes to the tier of the smallest context that holds it, and waits there whole. Once a tier holds
enough pieces its windows are packed, longest piece first; the gap that remains is filled with the longest whole pieces
that fit, of this tier or of shorter ones, and what is still open then is closed by cutting one piece, whose rest waits
on. So every window is full, and a window cuts one document at most. At the end the tiers are packed from the longest
down; the last tokens form windows whose lengths are powers of two, so no window needs padding.

A step group holds step_tokens worth of windows of one tier, over all partitions: the windows that each partition made
of a tier are counted, and their numbers follow from running sums of the counts. So all groups of a tier are equal but
for its last one. The partition's closing windows (below the smallest tier) count as windows of the smallest tier.

Defined cases: null and empty texts are the end id alone; null ids are kept; repeated rows are packed one by one; an
empty table gives no piece; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, stored
from .tokenizer import encoder, vocabulary

PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, part int, number long"
#: Sequence ids of a partition start at its number times this.
PER_PARTITION = 1 << 36


class Packer:
    """Windows of one partition. take() and close() return pieces whose window is complete: doc, start, length, crc32,
    doc_tokens, sequence, offset, tier, and the window's number among those of its tier."""

    def __init__(self, tiers: tuple[int, ...], first: int, held: int = 64):
        self.tiers = sorted(tiers)
        self.largest = self.tiers[-1]
        self.next = first
        self.made = dict.fromkeys(self.tiers, 0)
        # Waiting pieces of each tier by length: (length, order, doc, start, ids, doc_tokens). The order tells them apart.
        self.waiting: dict[int, list[tuple]] = {t: [] for t in self.tiers}
        self.tokens = dict.fromkeys(self.tiers, 0)
        self.most = {t: t * held for t in self.tiers}
        self.order = count()

    def _tier(self, size: int) -> int:
        return self.tiers[bisect_left(self.tiers, size)]

    def _wait(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        tier = self._tier(len(ids))
        insort(self.waiting[tier], (len(ids), next(self.order), doc, start, ids, total))
        self.tokens[tier] += len(ids)

    def _pop(self, tier: int, at: int) -> tuple:
        piece = self.waiting[tier].pop(at)
        self.tokens[tier] -= piece[0]
        return piece

    def _fitting(self, tier: int, gap: int) -> tuple | None:
        """The longest whole piece of at most `gap` tokens, of this tier or a shorter one."""
        for t in reversed(self.tiers[: self.tiers.index(tier) + 1]):
            at = bisect_left(self.waiting[t], (gap + 1,)) - 1
            if at >= 0:
                return self._pop(t, at)
        return None

    def _cut(self, tier: int, gap: int) -> tuple:
        """The first `gap` tokens of the shortest piece that is longer; the rest waits on."""
        for t in self.tiers[: self.tiers.index(tier) + 1]:
            at = bisect_left(self.waiting[t], (gap + 1,))
            if at < len(self.waiting[t]):
                _, order, doc, start, ids, total = self._pop(t, at)
                self._wait(doc, start + gap, ids[gap:], total)
                return gap, order, doc, start, ids[:gap], total
        raise ValueError("no piece to cut")

    def _window(self, tier: int, size: int) -> list[tuple]:
        """A window of `size` tokens from pieces of the tier and shorter ones, which hold as many at least."""
        pieces, gap = [], size
        while gap:
            piece = self._fitting(tier, gap) or self._cut(tier, gap)
            pieces.append(piece[2:])
            gap -= piece[0]
        return self._closed(pieces, self._tier(size))

    def _closed(self, pieces: list[tuple], tier: int) -> list[tuple]:
        offset, out = 0, []
        for doc, start, ids, total in pieces:
            out.append((doc, start, len(ids), zlib.crc32(ids), total, self.next, offset, tier, self.made[tier]))
            offset += len(ids)
        self.next += 1
        self.made[tier] += 1
        return out

    def take(self, doc: int | None, ids: np.ndarray) -> list[tuple]:
        out, total, start = [], len(ids), 0
        while total - start >= self.largest:
            out += self._closed([(doc, start, ids[start : start + self.largest], total)], self.largest)
            start += self.largest
        if start < total:
            self._wait(doc, start, ids[start:], total)
            tier = self._tier(total - start)
            if self.tokens[tier] >= self.most[tier]:
                while self.tokens[tier] >= self.most[tier] // 2:
                    out += self._window(tier, tier)
        return out

    def close(self) -> list[tuple]:
        out = []
        for tier in reversed(self.tiers):
            while self.waiting[tier] and sum(self.tokens[t] for t in self.tiers if t <= tier) >= tier:
                out += self._window(tier, tier)
        left = sum(self.tokens.values())
        while left:
            size = min(self.largest, 1 << (left.bit_length() - 1))
            out += self._window(self.largest, size)
            left -= size
        return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str | None = None, end: int = 1, tiers: tuple[int, ...] = (256, 512, 1024, 2048), step_tokens: int = 16 * 2048) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group (numbered
    within the tier). tiers: powers of two, and step_tokens a multiple of each. Documents are not shuffled, each partition
    is packed where it lies; the groups' numbers need one row per partition and tier."""
    if any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers are powers of two")
    if any(step_tokens % t for t in tiers):
        raise ValueError("step_tokens is a multiple of each tier")
    ship(docs.sparkSession)
    vocab = vocab or vocabulary()
    kinds = {"int": pa.int32(), "long": pa.int64()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in PACKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        enc, packer = encoder(vocab, 200_000), Packer(tiers, part * PER_PARTITION)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = [*zip(*rows)]
            cols.insert(8, (part,) * len(rows))
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, schema.types)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for doc, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist(), end)):
                    rows += packer.take(doc, ids)
                if len(rows) >= 5000:
                    yield out()
                    rows = []
        rows += packer.close()
        if rows:
            yield out()

    packed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, PACKED)
    return step_groups(stored(packed, "pieces"), step_tokens)


def step_groups(pieces: DataFrame, step_tokens: int) -> DataFrame:
    """pieces with step_group: windows of a tier in order of partition, step_tokens worth to a group."""
    made = pieces.groupBy("part", "tier").agg((F.max("number") + 1).alias("made"))
    before = Window.partitionBy("tier").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    made = made.select("part", "tier", F.coalesce(F.sum("made").over(before), F.lit(0)).alias("before"))
    group = F.floor((F.col("before") + F.col("number")) * F.col("tier") / step_tokens).cast("long")
    return pieces.join(made, ["part", "tier"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", group.alias("step_group"))
