"""Exact order statistics without a window or a buffer over a whole group: values are counted first, cut into blocks by
size, and running totals of the blocks are joined to running totals inside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of a group's range of values.
BLOCKS = 1024


def at_ranks(rows: DataFrame, value: str, by: list[str], ranks: dict[str, Column]) -> DataFrame:
    """by and, for each name, the smallest value with at least that many values up to it. ranks: conditions on n, the
    group's number of values."""
    group = F.struct(*by) if by else F.struct(F.lit(0))  # equal structs may hold nulls
    counts = rows.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("x")).agg(F.count("*").alias("c"))
    ends = counts.groupBy("g").agg(F.min("x").alias("least"), F.max("x").alias("most"), F.sum("c").alias("n"))
    share = (F.col("x") - F.col("least")) / F.greatest(F.col("most") - F.col("least"), F.lit(1e-300))
    counts = counts.join(ends, "g").withColumn("block", F.least(F.floor(share * BLOCKS), F.lit(BLOCKS - 1)).cast("int"))
    sums = counts.groupBy("g", "block").agg(F.sum("c").alias("s"))
    earlier = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("g", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("g", "block").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(sums, ["g", "block"]).withColumn("upto", F.col("before") + F.sum("c").over(inside))
    found = placed.groupBy("g").agg(*(F.min(F.when(F.col("upto") >= rank, F.col("x"))).alias(name) for name, rank in ranks.items()))
    return found.select(*(F.col(f"g.{c}").alias(c) for c in by), *ranks)
