"""Streaming folds. The state's fold is a lattice, so a micro-batch merges into it in any order and any number of
times: replays after a failure change nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fold_stream(ops: DataFrame) -> DataFrame:
    """A streaming DataFrame of the folded state (update mode): the batch fold's aggregates, kept by Spark."""
    fill = F.when(F.col("op") == "fill", F.struct("rv", "fv", (-F.col("seq")).alias("first")))
    state = ops.where(F.col("op").isin("fill", "tombstone")).groupBy("key").agg(F.max(fill).alias("f"), F.max(F.when(F.col("op") == "tombstone", F.col("version"))).alias("tv"))
    return state.select("key", F.col("f.rv").alias("rv"), F.col("f.fv").alias("fv"), "tv", F.coalesce(F.col("f.rv") >= F.coalesce("tv", F.lit(0)), F.lit(False)).alias("live"))


def run_once(stream: DataFrame, sink: str, checkpoint: str, mode: str = "update") -> None:
    """Processes what is there now into a Parquet folder, and ends. Each micro-batch writes what changed, and nothing
    else, into a folder of its own (batch=n), which a replay of the batch replaces."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch={n}")

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def latest(spark: SparkSession, sink: str, schema: str, *keys: str) -> DataFrame:
    """What run_once's folder says now: of each key the rows of the last batch that wrote any."""
    rows = spark.read.schema(f"{schema}, batch long").parquet(sink)
    last = rows.groupBy(*keys).agg(F.max("batch").alias("batch"))
    return rows.join(last, [*keys, "batch"]).drop("batch")


def from_now(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A change stream that begins with what comes next: files that are there already are no changes, as a fold that starts
    without a checkpoint must not take a snapshot for one."""
    from datetime import UTC, datetime

    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S")
    return spark.readStream.schema(schema).option("modifiedAfter", now).option("timeZone", "UTC").parquet(path)


def deliver(stream: DataFrame, invalidate: Callable[[DataFrame], None], checkpoint: str):
    """Starts at-least-once delivery of a change stream. A batch whose invalidation raises is not committed: it comes
    again, and the checkpoint stays where it is."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: invalidate(batch)).start()
