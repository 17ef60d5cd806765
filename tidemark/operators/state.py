"""Versioned keyed state: folds of operation logs by compare-and-set.

The fold is a lattice: per key the largest fill (by row version, fill version, then earliest arrival) and the largest
tombstone. It is commutative, associative and idempotent, so it is one aggregate with partial results before the
shuffle (a sort aggregate, as its buffer is a struct), and arrival order, replay and skewed keys don't matter. Replays
that need each operation's own outcome are windows over the operations before it, or folds of a key's sorted operations
inside tasks where one outcome decides the next.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType


def fold_state(ops: DataFrame) -> DataFrame:
    """ops (key, seq, op, rv, fv, version, payload?) to one row per key: rv, fv, tv, live, negative, payload.

    op: fill (rv, fv) or tombstone (version); other kinds are no writes. A fill is live if no tombstone is above its
    row version."""
    extra = [c for c in ("negative", "fingerprint", "expires_at_ms", "payload") if c in ops.columns]
    fill = F.when(F.col("op") == "fill", F.struct("rv", "fv", (-F.col("seq")).alias("first"), *extra))
    tomb = F.when(F.col("op") == "tombstone", F.col("version"))
    # max over a struct keeps whole rows together; the payload travels with the winner.
    state = ops.where(F.col("op").isin("fill", "tombstone")).groupBy("key").agg(F.max(fill).alias("f"), F.max(tomb).alias("tv"))
    live = F.coalesce(F.col("f.rv") >= F.coalesce("tv", F.lit(0)), F.lit(False))
    return state.select("key", F.col("f.rv").alias("rv"), F.col("f.fv").alias("fv"), "tv", live.alias("live"), *(F.when(live, F.col(f"f.{c}")).alias(c) for c in extra))


def replay_applied(ops: DataFrame, *partition: str) -> DataFrame:
    """ops with `applied`: whether each fill or tombstone wins against all before it (by seq) of its key."""
    before = Window.partitionBy(*(partition or ("key",))).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fill = F.when(F.col("op") == "fill", F.struct("rv", "fv"))
    pf, pt = F.max(fill).over(before), F.max(F.when(F.col("op") == "tombstone", F.col("version"))).over(before)
    staged = ops.withColumn("_pf", pf).withColumn("_pt", pt)
    filled = (F.col("rv") >= F.coalesce("_pt", F.lit(0))) & (F.col("_pf").isNull() | (F.struct("rv", "fv") > F.col("_pf")))
    buried = (F.col("version") > F.coalesce("_pf.rv", F.lit(-1))) & (F.col("version") > F.coalesce("_pt", F.lit(0)))
    return staged.withColumn("applied", F.when(F.col("op") == "fill", filled).when(F.col("op") == "tombstone", buried)).drop("_pf", "_pt")


def expiry_epochs(ops: DataFrame, ttl_ms: int) -> DataFrame:
    """ops with `epoch` and `applied`: an entry ends ttl_ms after the last write that won (losing writes don't keep it),
    and the first write after that begins a new epoch, against nothing. Rows without time or kind are kept, never applied.

    Sequential per key: a task walks its keys' operations in order and holds one entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, epoch, entry, tomb, ends = None, 0, None, None, None
        for batch in batches:
            epochs, applied = [], []
            for k, op, at, rv, fv, version in zip(*(batch.column(c).to_pylist() for c in ("key", "op", "at_ms", "rv", "fv", "version"))):
                if k != key or not epoch:
                    key, epoch, entry, tomb, ends = k, 1, None, None, None
                if ends is not None and at is not None and at >= ends:
                    epoch, entry, tomb, ends = epoch + 1, None, None, None
                won = False
                if op == "fill" and rv is not None and fv is not None:
                    won = rv >= (tomb or 0) and (entry is None or (rv, fv) > entry)
                    entry = (rv, fv) if won else entry
                elif op == "tombstone" and version is not None:
                    won = version > (-1 if entry is None else entry[0]) and version > (tomb or 0)
                    if won:
                        tomb, entry = version, None
                if won and at is not None:
                    ends = at + ttl_ms
                epochs.append(epoch)
                applied.append(won)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(epochs, pa.int64()), pa.array(applied, pa.bool_())], [*batch.schema.names, "epoch", "applied"])

    kind = StructType([*ops.schema.fields, StructField("epoch", LongType()), StructField("applied", BooleanType())])
    return ops.repartition("key").sortWithinPartitions("key", "seq").mapInArrow(run, kind)


def remaining_ttl(asked: DataFrame, entries: DataFrame, now_ms: int) -> DataFrame:
    """asked (key) against entries (key, expires_at_ms): milliseconds left, -2 where there is no entry (or it has
    expired), null where an entry has no end, which is an error: nothing may live for ever."""
    own = entries.select("key", F.lit(True).alias("present"), "expires_at_ms")
    left = F.col("expires_at_ms") - now_ms
    gone = F.col("present").isNull() | (left <= 0)
    return asked.select("key").distinct().join(own, "key", "left").select("key", F.when(gone, F.lit(-2)).otherwise(left).cast("long").alias("ttl_ms"), (F.col("present").isNotNull() & F.col("expires_at_ms").isNull()).alias("endless"))


def flushed(state: DataFrame) -> DataFrame:
    """The state after a flush: nothing, in the same columns."""
    return state.where(F.lit(False))


def readable(state: DataFrame, fingerprint: str | None = None, now_ms: int | None = None) -> DataFrame:
    """The entries that readers see: live, of the expected fingerprint, not expired. The fold never filters these."""
    out = state.where("live")
    if fingerprint is not None:
        out = out.where(F.col("fingerprint") == fingerprint)
    return out if now_ms is None else out.where(F.col("expires_at_ms") > now_ms)


def stamp_hlc(ops: DataFrame, partition: str = "shard", block_rows: int = 65_536) -> DataFrame:
    """ops (clock: next | now | observe, wall_ms, v) with `hlc`, the clock's reading after each, per partition by seq.

    last = n + max(0, running max of (candidate - n)), n the count of `next` so far: the recurrence in closed form. Both
    are associative, so a partition is cut into blocks of seq, windows run inside blocks, and each block gets the count
    and the maximum of those before it from one row per block."""
    order = Window.partitionBy(partition, "_block").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    candidate = F.when(F.col("clock") == "observe", F.col("v")).otherwise(F.shiftleft(F.col("wall_ms"), 16))
    staged = ops.withColumn("_block", F.floor(F.col("seq") / block_rows).cast("long"))
    # A `next` at wall clock w after a smaller reading gives w itself: its own tick is in n, so w - n leads by w - n.
    staged = staged.withColumn("_n", F.sum((F.col("clock") == "next").cast("long")).over(order)).withColumn("_lead", candidate - F.col("_n"))
    staged = staged.withColumn("_top", F.max("_lead").over(order))
    earlier = Window.partitionBy(partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = staged.groupBy(partition, "_block").agg(F.max("_n").alias("_ticks"), F.max("_top").alias("_most"))
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_ticks").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("_reached", F.max(F.col("_most") - F.col("_before")).over(earlier)).select(partition, "_block", "_before", "_reached")
    rows = staged.join(blocks, [partition, "_block"])
    n = F.col("_before") + F.col("_n")
    return rows.withColumn("hlc", n + F.greatest(F.lit(0), "_reached", F.col("_top") - F.col("_before"))).select(*ops.columns, "hlc")


def latest_by_key(rows: DataFrame, key: list[str], version: str, ties: list[str]) -> DataFrame:
    """The row of the largest version of each key; ties by the tie columns, then by all others. One aggregate
    with partial results (a sort aggregate: its buffer is a struct)."""
    rest = [c for c in rows.columns if c not in {*key, version, *ties}]
    best = F.max(F.struct(version, *ties, *rest)).alias("_best")
    return rows.groupBy(*key).agg(best).select(*(F.col(c) if c in key else F.col(f"_best.{c}").alias(c) for c in rows.columns))


def lost_invalidations(ops: DataFrame) -> DataFrame:
    """Tombstones that lost, with the entry version they could not bury: deletes at or below what is cached."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    held = F.max(F.when(F.col("op") == "fill", F.col("rv"))).over(before)
    return replay_applied(ops).withColumn("held_rv", held).where((F.col("op") == "tombstone") & ~F.col("applied")).select("seq", "key", "version", "held_rv")


def invalidations(writes: DataFrame, changes: DataFrame) -> DataFrame:
    """Tombstones (key, version, source) of the write path and of the change stream, each key and version once."""
    both = writes.select("key", "version", F.lit("write_path").alias("source")).unionByName(changes.select("key", "version", F.lit("cdc").alias("source")))
    return both.groupBy("key", "version").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def change_keys(events: DataFrame) -> DataFrame:
    """Tombstones of change events (key_before, key_after, version, action): both keys where an update changes it."""
    keys = F.array_distinct(F.filter(F.array("key_before", "key_after"), lambda k: k.isNotNull()))
    return events.where("version is not null and version > 0").select(F.explode(keys).alias("key"), "version")


def frozen_position(events: DataFrame) -> DataFrame:
    """Per shard the position up to which a change stream is safe: before its first undelivered event, else its last."""
    undelivered = F.min(F.when(~F.col("delivered"), F.struct("file", "offset")))
    return events.groupBy("shard").agg(undelivered.alias("stuck"), F.max(F.struct("file", "offset")).alias("last")).select("shard", F.coalesce("stuck", "last").alias("p"), F.col("stuck").isNotNull().alias("frozen")).select("shard", F.col("p.file").alias("file"), F.col("p.offset").alias("offset"), "frozen")
