"""Consistency analytics: comparisons of cache and origin, how long a key is behind, violated levels, objectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import nines

#: Levels that each tier of comparison can speak about.
TIERS = {"value": ["EVENTUAL"], "version": ["SESSION", "BOUNDED", "EVENTUAL"], "native": ["SESSION", "BOUNDED", "EVENTUAL"]}


def propagation_bound(write_ms: int = 50, cdc_ms: int = 5000, skew_ms: int = 250) -> int:
    return write_ms + cdc_ms + skew_ms


def compare(entries: DataFrame, origin: DataFrame, tier: str = "version", cached: str = "fv", stored: str = "version") -> DataFrame:
    """Keys on both sides with `behind` (null: the side data that the tier needs is missing, an error and no violation).
    A key missing on either side is forgotten: an inner join."""
    rows = entries.alias("c").join(origin.alias("o"), "key")
    a, b = F.col(f"c.{cached}"), F.col(f"o.{stored}")
    behind = ~a.eqNullSafe(b) if tier == "value" else F.when(a.isNotNull() & b.isNotNull(), a < b)
    return rows.select("key", a.alias("cache_value"), b.alias("origin_value"), behind.alias("behind"))


def behind_since(observations: DataFrame) -> DataFrame:
    """observations (key, at_ms, seq, behind) with behind_since_ms: the first observation of the current run of
    behind ones (gaps and islands: a running count of resets names the run)."""
    order = Window.partitionBy("key").orderBy("at_ms", "seq")
    resets = F.sum((~F.coalesce("behind", F.lit(False))).cast("int")).over(order)
    rows = observations.withColumn("_run", resets)
    first = F.min(F.when(F.col("behind"), F.col("at_ms"))).over(Window.partitionBy("key", "_run").orderBy("at_ms", "seq"))
    return rows.withColumn("behind_since_ms", F.when(F.col("behind"), first)).drop("_run")


def violated_levels(behind: Column, behind_ms: Column, fill_version: Column, watermark: Column, window_ms: Column, bound_ms: int, skew_ms: int = 250, tier: str = "version") -> Column:
    """Array of the levels that an observation violates. Within the propagation bound nothing is violated; STRONG never
    is, as it doesn't read the cache."""
    late = F.coalesce(behind & (behind_ms > bound_ms), F.lit(False))
    told = {"EVENTUAL": F.lit(True), "SESSION": F.coalesce(watermark.isNotNull() & (fill_version < watermark), F.lit(False)), "BOUNDED": F.coalesce((window_ms > 0) & (behind_ms > window_ms + skew_ms), F.lit(False))}
    own = F.filter(F.array(*(F.when(late & told[level], F.lit(level)) for level in TIERS[tier])), lambda x: x.isNotNull())
    return own


def classify(observations: DataFrame, bound_ms: int, skew_ms: int = 250, tier: str = "version") -> DataFrame:
    """observations (at_ms, behind, behind_since_ms, fv, watermark, window_ms) with behind_ms and levels."""
    rows = observations.withColumn("behind_ms", F.when(F.col("behind"), F.col("at_ms") - F.col("behind_since_ms")))
    return rows.withColumn("levels", violated_levels(F.col("behind"), F.col("behind_ms"), F.col("fv"), F.col("watermark"), F.col("window_ms"), bound_ms, skew_ms, tier))


def per_level(classified: DataFrame, tier: str = "version", *keep: str) -> DataFrame:
    """A row for each observation and level of the tier, with `violation`."""
    return classified.select(*keep, "levels", F.explode(F.array(*map(F.lit, TIERS[tier]))).alias("level")).select(*keep, "level", F.array_contains("levels", F.col("level")).alias("violation"))


def slo_report(observations: DataFrame, *by: str) -> DataFrame:
    """observations (level, violation): how many, violations, consistency and nines per level."""
    n, v = F.count("*"), F.count_if("violation")
    return observations.groupBy("level", *by).agg(n.alias("observations"), v.alias("violations"), ((n - v) / n).alias("consistency"), nines(n, v).alias("nines"))


def slo_rolling(observations: DataFrame, window_ms: int, blocks: int = 64) -> DataFrame:
    """observations (level, at_ms, violation) with the counts of the window that ends at each (its start excluded).

    Each observation counts from its time on and no more from window_ms later on, so a window's counts are running sums of
    such changes, and cost no more where windows hold more rows. Time is cut into blocks, `blocks` to a window: the sums run
    inside blocks, and one row per level and block carries what came before. Observations without a time are a window."""
    row, late = F.struct(*(F.col(f"`{c}`") for c in observations.columns)), F.col("violation").cast("long")
    starts = observations.select("level", F.col("at_ms").alias("_at"), F.lit(1).alias("_n"), late.alias("_v"), row.alias("_row"))
    ends = observations.where("at_ms is not null").select("level", (F.col("at_ms") + window_ms).alias("_at"), F.lit(-1).alias("_n"), (-late).alias("_v"), F.lit(None).alias("_row"))
    changes = starts.unionByName(ends).withColumn("_block", F.floor(F.col("_at") / max(1, window_ms // blocks)))
    sums = changes.where("_block is not null").groupBy("level", "_block").agg(F.sum("_n").alias("_n"), F.sum("_v").alias("_v"))
    earlier = Window.partitionBy("level").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("level").alias("_level"), F.col("_block").alias("_of"), F.sum("_n").over(earlier).alias("_n0"), F.sum("_v").over(earlier).alias("_v0"))
    inside = Window.partitionBy("level", "_block").orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    run = changes.select("level", "_block", "_row", F.sum("_n").over(inside).alias("_n"), F.sum("_v").over(inside).alias("_v")).where("_row is not null")
    run = run.join(sums, F.col("level").eqNullSafe(F.col("_level")) & (F.col("_block") == F.col("_of")), "left")
    counts = run.select("_row.*", *((F.col(c) + F.coalesce(f"{c}0", F.lit(0))).alias(name) for c, name in (("_n", "observations"), ("_v", "violations"))))
    return counts.withColumn("nines", nines(F.col("observations"), F.col("violations")))


def trace(events: DataFrame, most: int = 32, most_keys: int | None = None) -> DataFrame:
    """Each key's last `most` events, of the most_keys keys touched last."""
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("at_ms"), F.desc("seq")))
    rows = events.withColumn("rank", rank).where(F.col("rank") <= most)
    if most_keys is not None:
        last = events.groupBy("key").agg(F.max(F.struct("at_ms", "seq")).alias("last")).orderBy(F.desc("last"), "key").limit(most_keys)
        rows = rows.join(last.select("key"), "key", "left_semi")
    return rows


def violation_traces(violations: DataFrame, events: DataFrame, most: int = 32) -> DataFrame:
    """violations (key) with trace: the key's last events, newest last, bounded by `most`."""
    item = F.struct("at_ms", "seq", "op", "version")
    traces = trace(events, most).groupBy("key").agg(F.array_sort(F.collect_list(item)).alias("trace"))
    return violations.join(traces, "key", "left")


def sampling_rounds(keys: DataFrame, every_ms: int = 1000, batch: int = 100) -> DataFrame:
    """keys (key, i: 0-based place in the list) with the round in which each is checked first, and when: `batch` keys every
    every_ms, in turn, and again from the start when all have been checked."""
    return keys.select("key", F.floor(F.col("i") / batch).cast("long").alias("round"), (F.floor(F.col("i") / batch) * every_ms).cast("long").alias("at_ms"))


def round_stats(checks: DataFrame, *by: str) -> DataFrame:
    """What a verifier has done, over its checks (round, behind, levels): rounds, checked keys, violations (one for each
    level that a check breaks) and errors (checks whose sides could not be compared)."""
    return checks.groupBy(*by).agg(F.count_distinct("round").alias("rounds"), F.count("*").alias("checked"), F.coalesce(F.sum(F.size("levels")), F.lit(0)).cast("long").alias("violations"), F.count_if(F.col("behind").isNull()).alias("errors"))


def false_positive_rate(stats: DataFrame, most: float = 0.01) -> DataFrame:
    """stats of a writer that is known to be correct, with the share of checks reported all the same, and whether it is low
    enough for a verifier that anybody keeps running."""
    rate = F.when(F.col("checked") > 0, F.col("violations") / F.col("checked")).otherwise(0.0)
    return stats.withColumn("rate", rate).withColumn("acceptable", rate <= most)


def shadow(measured: DataFrame, on: bool = True) -> DataFrame:
    """The same figures with the label of a shadow run, which measures and changes nothing."""
    return measured.withColumn("shadow_mode", F.lit(on))


def inspect(keys: DataFrame, entries: DataFrame, origin: DataFrame) -> DataFrame:
    """keys (key) with what the cache (key, rv, fv, live) and the origin (key, version) hold of each, and what that means:
    absent, not_cached, orphaned (cached, no row), behind, current."""
    cached = entries.where("live").select("key", "rv", "fv")
    rows = keys.select("key").distinct().join(cached, "key", "left").join(origin.select("key", F.col("version").alias("origin_version")), "key", "left")
    has, exists = F.col("rv").isNotNull(), F.col("origin_version").isNotNull()
    state = F.when(~has & ~exists, "absent").when(~has, "not_cached").when(~exists, "orphaned").when(F.col("rv") < F.col("origin_version"), "behind").otherwise("current")
    return rows.withColumn("state", state)
