"""Session watermarks and freshness-qualified reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import accepts


def watermarks_before(log: DataFrame, version: str = "version", advances: Column | None = None) -> DataFrame:
    """log with `watermark`: the largest version that its (session, shard) wrote or saw before each row, by seq."""
    before = Window.partitionBy("session", "shard").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.col(version) if advances is None else F.when(advances, F.col(version))
    return log.withColumn("watermark", F.max(seen).over(before))


def session_tokens(log: DataFrame, version: str = "version", most: int = 64) -> DataFrame:
    """Each session's watermark of each shard, the `most` largest of them (the client drops the lowest)."""
    marks = log.where(F.col(version).isNotNull()).groupBy("session", "shard").agg(F.max(version).alias("watermark"))
    rank = F.row_number().over(Window.partitionBy("session").orderBy(F.desc("watermark"), "shard"))
    return marks.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")


def accept_reads(reads: DataFrame, level: str | Column, bound_ms: int = 0, skew_ms: int = 250) -> DataFrame:
    """reads (fv, watermark, at_ms) with `accepted`."""
    wanted = F.lit(level) if isinstance(level, str) else level
    return reads.withColumn("accepted", accepts(wanted, F.col("fv"), F.col("watermark"), F.col("at_ms"), F.lit(bound_ms), skew_ms))


def non_monotonic_reads(reads: DataFrame, version: str = "row_version") -> DataFrame:
    """Reads whose row version is below one that the session saw of the same key before."""
    before = Window.partitionBy("session", "key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return reads.withColumn("seen", F.max(version).over(before)).where(F.col(version) < F.col("seen"))
