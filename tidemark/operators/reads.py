"""Reads and writes resolved over request logs: outcomes, batches, conditional updates, leases, standby pools."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..functions.columns import accepts


def resolve_reads(requests: DataFrame, entries: DataFrame, origin: DataFrame, *, skew_ms: int = 250, strong_fills: bool = False) -> DataFrame:
    """requests (seq, key, level, bound_ms, watermark, at_ms) against entries (key, rv, fv, live, negative) and origin
    (key, version): outcome (hit, negative_hit, stale, miss, bypass), found, row_version, filled.

    Two equi-joins on key, both sides' columns already narrow; absence is told by explicit flags, never by null."""
    cached = entries.where("live").select("key", F.lit(True).alias("present"), "rv", "fv", F.coalesce("negative", F.lit(False)).alias("negative"))
    stored = origin.select("key", F.lit(True).alias("exists"), F.col("version").alias("origin_version"))
    rows = requests.join(cached, "key", "left").join(stored, "key", "left")
    present = F.coalesce("present", F.lit(False))
    good = present & F.coalesce(accepts(F.col("level"), F.col("fv"), F.col("watermark"), F.col("at_ms"), F.col("bound_ms"), skew_ms), F.lit(False))
    outcome = F.when(F.col("level") == "STRONG", "bypass").when(good & F.col("negative"), "negative_hit").when(good, "hit").when(present, "stale").otherwise("miss")
    served = outcome.isin("hit", "negative_hit")
    found = F.when(outcome == "hit", True).when(outcome == "negative_hit", False).otherwise(F.coalesce("exists", F.lit(False)))
    version = F.when(outcome == "hit", F.col("rv")).when(outcome == "negative_hit", F.lit(0)).otherwise(F.coalesce("origin_version", F.lit(0)))
    return rows.select("seq", "key", "level", outcome.alias("outcome"), found.alias("found"), version.alias("row_version"), served.alias("cache_hit"), (~served & ((F.col("level") != "STRONG") | F.lit(strong_fills))).alias("filled"))


def batch_get(keys: DataFrame, origin: DataFrame, key: str = "key") -> DataFrame:
    """Rows of the origin whose key is asked for, each once; keys without a row are left out."""
    return origin.join(keys.select(key).distinct(), key, "left_semi")


def batch_missing(keys: DataFrame, origin: DataFrame, key: str = "key") -> DataFrame:
    return keys.select(key).distinct().join(origin.select(key), key, "left_anti")


def shard_groups(keys: DataFrame, shard: Column) -> DataFrame:
    """How many distinct keys each shard is asked for, and how many asks that saves."""
    return keys.select("key", shard.alias("shard")).groupBy("shard").agg(F.count_distinct("key").alias("n_keys"), F.count("*").alias("asked"))


def update_where(rows: DataFrame, match: Column, key: str, budget: int, shard: str = "shard") -> DataFrame:
    """Per shard matched rows, whether it is degraded (over budget), and the keys to invalidate: none of any shard if
    one is degraded. A shard's key list has at most `budget` keys, so it is bounded."""
    hits = rows.where(match)
    ranked = hits.withColumn("_r", F.row_number().over(Window.partitionBy(shard).orderBy(key))).where(F.col("_r") <= budget + 1)
    keys = ranked.groupBy(shard).agg(F.max("_r").alias("probed"), F.array_sort(F.collect_list(key)).alias("found"))
    counts = hits.groupBy(shard).agg(F.count("*").alias("matched"))
    out = counts.join(keys, shard).withColumn("degraded", F.col("probed") > budget)
    whole = Window.partitionBy()
    out = out.withColumn("any_degraded", F.max("degraded").over(whole))
    return out.select(shard, "matched", "degraded", F.when(F.col("any_degraded"), F.slice("found", 1, 0)).otherwise(F.col("found")).alias("keys"))


def valid_matches(requests: DataFrame, declared: list[tuple[list[str], list[str]]]) -> DataFrame:
    """requests (match_columns, set_columns: arrays) with `declared`: whether both are, as multisets, those of one declared
    conditional write; a column that appears twice never is."""
    same = [(F.array_sort("match_columns") == F.array(*map(F.lit, sorted(m)))) & (F.array_sort("set_columns") == F.array(*map(F.lit, sorted(c)))) for m, c in declared]
    known = F.lit(False)
    for one in same:
        known = known | one
    return requests.withColumn("declared", F.coalesce(known, F.lit(False)))


def lease_outcomes(misses: DataFrame, lease_ms: int = 2000, attempts: int = 4, first_wait_ms: int = 5, most_wait_ms: int = 50, fills: DataFrame | None = None) -> DataFrame:
    """misses (key, at_ms, seq) with `outcome`: granted to the first miss of a key while no lease is out, waited while
    the lease's fill comes within the waits' total, else wait_exhausted; since_ms: time since the grant. A lease ends
    lease_ms after its grant, or with its holder's fill (fills: key, at_ms, seq): the next miss is granted.

    Sequential: a task walks its keys' events in order and holds the current key and the time of its last grant."""
    waits, wait = 0, first_wait_ms
    for _ in range(attempts):
        waits, wait = waits + wait, min(2 * wait, most_wait_ms)
    columns = misses.columns
    events = misses.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), "key", "at_ms", "seq", F.lit(False).alias("fill"))
    if fills is not None:
        none = F.lit(None).cast(events.schema["row"].dataType)
        events = events.unionByName(fills.select(none.alias("row"), "key", "at_ms", "seq", F.lit(True).alias("fill")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, grant = None, None
        for batch in batches:
            granted, since, misses_at = [], [], []
            for i, (k, at, fill) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("key", "at_ms", "fill")))):
                if k != key:
                    key, grant = k, None
                if fill:
                    grant = None
                    continue
                new = at is None or grant is None or at - grant >= lease_ms
                if new:
                    grant = at
                misses_at.append(i)
                granted.append(new)
                since.append(None if at is None else at - grant)
            rows = batch.column("row").take(pa.array(misses_at, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows, pa.array(granted, pa.bool_()), pa.array(since, pa.int64())], ["row", "granted", "since"])

    kind = StructType([StructField("row", events.schema["row"].dataType), StructField("granted", BooleanType()), StructField("since", LongType())])
    rows = events.repartition("key").sortWithinPartitions("key", "at_ms", "seq").mapInArrow(run, kind)
    outcome = F.when(F.col("granted"), "granted").when(F.col("since") <= waits, "waited").otherwise("wait_exhausted")
    return rows.select(*(F.col(f"row.`{c}`") for c in columns), F.col("since").alias("since_ms"), outcome.alias("outcome"))


def gated(reads: DataFrame, admitted: Column, shed: Column, u: Column, bound_ms: Column, skew_ms: int = 250) -> DataFrame:
    """resolve_reads' rows as the gates let them through. A key that isn't admitted is read at the origin and not filled;
    a share `shed` of the reads of a failing node (u below it) goes past the cache the same way. With what is told
    about a read: the level served, whether the cache answered, the reason and the staleness bound (none at the origin)."""
    gate = F.when(F.col("level") == "STRONG", "strong").when(~admitted, "not_admitted").when(u < shed, "shed")
    reason = F.coalesce(gate, F.col("outcome"))
    hit = gate.isNull() & F.col("cache_hit")
    bound = F.when(hit & (F.col("level") == "BOUNDED"), bound_ms - skew_ms)
    return reads.select("seq", "key", F.col("level").alias("level_served"), hit.alias("cache_hit"), reason.alias("reason"), (gate.isNull() & F.col("filled")).alias("filled"), bound.cast("long").alias("staleness_bound_ms"))


def standby_ops(ops: DataFrame, home_up: Column) -> DataFrame:
    """The fills and tombstones that go to the standby pool: those made while the key's home pool is down. Folded like
    any other log; nothing invalidates them later, their short time to live bounds how stale they get."""
    return ops.where(~home_up)


def with_standby(reads: DataFrame, standby: DataFrame, home_up: Column, ttl_ms: int = 30_000) -> DataFrame:
    """reads with served_by: the home pool while it is up; else a standby entry (degraded, stale by at most its time to
    live), else the origin. A miss of a healthy home pool never asks the standby."""
    other = standby.where("live").select("key", F.lit(True).alias("in_standby"))
    rows = reads.join(other, "key", "left")
    served = F.when(home_up, F.when(F.col("cache_hit"), "cache").otherwise("origin")).when(F.coalesce("in_standby", F.lit(False)), "standby").otherwise("origin")
    return rows.withColumn("served_by", served).withColumn("degraded", served == "standby").withColumn("staleness_bound_ms", F.when(served == "standby", F.lit(ttl_ms))).drop("in_standby")


def delete_results(log: DataFrame) -> DataFrame:
    """Deletes with `existed`: whether the key's last write before was a put; version 0 and no invalidation if not."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("put", "delete"), F.col("op")), ignorenulls=True).over(before)
    rows = log.withColumn("existed", F.coalesce(last == "put", F.lit(False))).where(F.col("op") == "delete")
    return rows.withColumn("version", F.when(F.col("existed"), F.col("version")).otherwise(F.lit(0)))
