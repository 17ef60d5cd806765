"""Telemetry: hit rates, origin load, latency and staleness percentiles, counter rates, histogram quantiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_ranks

PERCENTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99, "p999": 0.999}


def hit_rate(outcomes: DataFrame, *by: str) -> DataFrame:
    """outcomes (outcome): hits / (hits + misses + stale); stale entries count against the cache; 0 without reads."""
    hits, reads = F.count_if(F.col("outcome").isin("hit", "negative_hit")), F.count_if(F.col("outcome").isin("hit", "negative_hit", "miss", "stale"))
    return outcomes.groupBy(*by).agg(hits.alias("hits"), reads.alias("reads"), F.when(reads > 0, hits / reads).otherwise(0.0).alias("hit_rate"))


def origin_qps(outcomes: DataFrame, *by: str) -> DataFrame:
    """Origin reads per second of the span of at_ms."""
    n = F.count_if(~F.col("outcome").isin("hit", "negative_hit"))
    span = (F.max("at_ms") - F.min("at_ms")) / 1000
    return outcomes.groupBy(*by).agg(n.alias("origin_reads"), F.when(span > 0, n / span).otherwise(0.0).alias("origin_qps"))


def latency_summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """Exact percentiles (values that occur), largest, mean and count. Values are counted before they are ranked, so no
    task holds a group's values; `latency_sketch` is the cheaper way where near values do."""
    exact = at_ranks(rows, value, list(by), {n: F.ceil(F.col("n") * q) for n, q in PERCENTILES.items()})
    sums = rows.groupBy(*by).agg(F.max(value).alias("most"), F.avg(value).alias("mean"), F.count(value).alias("n"))
    if not by:
        return exact.crossJoin(sums)  # one row each
    same = [sums[c].eqNullSafe(exact[c]) for c in by]
    joined = sums.join(exact, reduce(lambda a, b: a & b, same), "left")
    return joined.select(*(sums[c] for c in by), *(F.col(n).cast("double").alias(n) for n in PERCENTILES), "most", "mean", "n")


def count_above(buckets: DataFrame, threshold: float, *by: str) -> DataFrame:
    """buckets (low, n: how many values lie in the bucket that begins at low): how many values are surely above the
    threshold, those of buckets that begin above it, and their share."""
    above, n = F.coalesce(F.sum(F.when(F.col("low") > threshold, F.col("n"))), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))
    return buckets.groupBy(*by).agg(above.alias("above"), n.alias("n"), F.when(n > 0, above / n).otherwise(0.0).alias("share"))


def success_ratio(samples: DataFrame, good: Column, *by: str) -> DataFrame:
    """The share of a counter's increase (samples: increase) that counts as good, summed by labels."""
    part = F.coalesce(F.sum(F.when(good, F.col("increase"))), F.lit(0.0))
    whole = F.coalesce(F.sum("increase"), F.lit(0.0))
    return samples.groupBy(*by).agg(part.alias("good"), whole.alias("whole"), F.when(whole > 0, part / whole).alias("ratio"))


def latency_sketch(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """A mergeable sketch of a bigint column per group, for logs too long for exact percentiles."""
    return rows.groupBy(*by).agg(F.expr(f"kll_sketch_agg_bigint(`{value}`)").alias("sketch"))


def merged_percentiles(sketches: DataFrame, *by: str) -> DataFrame:
    merged = sketches.groupBy(*by).agg(F.expr("kll_merge_agg_bigint(sketch)").alias("s"))
    return merged.select(*by, *(F.expr(f"kll_sketch_get_quantile_bigint(s, {q})").alias(n) for n, q in PERCENTILES.items()))


def lateness(requests: DataFrame, interval_us: int, run: str = "run") -> DataFrame:
    """Open-loop latency of requests (i, started_us, ended_us): from when the request was due, so that a stall counts.
    A run's start is a grouped minimum, joined back."""
    first = requests.groupBy(run).agg(F.min("started_us").alias("first_us"))
    rows = requests.join(first, run).withColumn("due_us", F.col("first_us") + F.col("i") * interval_us).drop("first_us")
    return rows.withColumn("latency_us", F.col("ended_us") - F.col("due_us")).withColumn("behind", F.col("started_us") - F.col("due_us") > interval_us)


def staleness(writes: DataFrame, reads: DataFrame, give_up_ms: int) -> DataFrame:
    """writes (key, seq, version, at_ms) with the time until the first read (key, row_version, at_ms) of at least that
    version, null if none came within give_up_ms."""
    w = writes.select("key", F.col("seq").alias("wseq"), "version", F.col("at_ms").alias("written_ms"), F.floor(F.col("at_ms") / give_up_ms).alias("b"))
    r = reads.select("key", "row_version", F.col("at_ms").alias("read_ms"), F.explode(F.array(F.floor(F.col("at_ms") / give_up_ms), F.floor(F.col("at_ms") / give_up_ms) - 1)).alias("b"))
    # A read meets the writes of its own time bucket and of the one before: an equi-join bounded by the give-up time.
    seen = w.join(r, ["key", "b"]).where("read_ms >= written_ms and row_version >= version").where(F.col("read_ms") - F.col("written_ms") <= give_up_ms)
    first = seen.groupBy("key", "wseq").agg(F.min("read_ms").alias("seen_ms"))
    return w.join(first, ["key", "wseq"], "left").select("key", F.col("wseq").alias("seq"), "version", (F.col("seen_ms") - F.col("written_ms")).alias("staleness_ms"))


def counter_rate(samples: DataFrame, by: list[str], slice_ms: int = 3_600_000) -> DataFrame:
    """Per-second rate between neighbouring samples (at_ms, value) of a counter; a fall is a restart from 0. Samples are
    compared inside time slices; a slice's first one meets the last one of the slices before, one row a slice."""
    rows = samples.withColumn("_slice", F.floor(F.col("at_ms") / slice_ms).cast("long"))
    inside, over_slices = Window.partitionBy(*by, "_slice").orderBy("at_ms"), Window.partitionBy(*by).orderBy("_slice")
    last = rows.groupBy(*by, "_slice").agg(F.max(F.struct("at_ms", "value")).alias("_last"))
    last = last.select(*(F.col(c).alias(f"_{c}") for c in by), F.col("_slice").alias("_at"), F.lag("_last").over(over_slices).alias("_before"))
    rows = rows.join(last, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by), F.col("_slice") == F.col("_at")))
    before = F.coalesce(F.lag(F.struct("at_ms", "value")).over(inside), F.col("_before"))
    rows = rows.withColumn("_before", before)
    grown = F.when(F.col("value") < F.col("_before.value"), F.col("value")).otherwise(F.col("value") - F.col("_before.value"))
    since = F.col("at_ms") - F.col("_before.at_ms")
    return rows.withColumn("rate", F.when(since > 0, grown * 1000.0 / since)).select(*samples.columns, "rate")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str]) -> DataFrame:
    """buckets (le, n: cumulative) per group: the quantile by linear interpolation inside its bucket."""
    order = Window.partitionBy(*by).orderBy("le")
    whole = Window.partitionBy(*by)
    rows = buckets.withColumn("low", F.coalesce(F.lag("le").over(order), F.lit(0.0))).withColumn("below", F.coalesce(F.lag("n").over(order), F.lit(0)))
    rows = rows.withColumn("rank", F.max("n").over(whole) * q).where((F.col("n") >= F.col("rank")) & (F.col("below") < F.col("rank")))
    inside = F.col("low") + (F.col("le") - F.col("low")) * (F.col("rank") - F.col("below")) / (F.col("n") - F.col("below"))
    return rows.groupBy(*by).agg(F.min(inside).alias("quantile"))


def quick_bench(log: DataFrame, hit_us: int = 500, miss_us: int = 5000) -> DataFrame:
    """What a cache would have done for a request log (seq, at_ms, key, op): a read is a hit if its key was read or put since
    its last delete. One row: reads, hits, hit_rate, origin_qps, and percentiles of modelled latencies."""
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.coalesce(F.last("op").over(before) != "delete", F.lit(False))
    rows = log.withColumn("outcome", F.when(known, "hit").otherwise("miss")).where("op = 'get'")
    rows = rows.withColumn("us", F.when(F.col("outcome") == "hit", hit_us).otherwise(miss_us))
    rates = hit_rate(rows).crossJoin(origin_qps(rows).select("origin_qps"))  # one row each
    return rates.crossJoin(at_ranks(rows, "us", [], {n: F.ceil(F.col("n") * q) for n, q in PERCENTILES.items() if n != "p999"}))
