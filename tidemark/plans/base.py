"""The test tables as operation logs, and the registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The events table as a log (CTE `log`): views and clicks read, purchases and sign-ups write, errors delete. Versions
#: run up to 60 hours late, so that later operations lose against earlier ones.
LOG_SQL = """
log as (
  select event_id as seq, epoch_us(ts) // 1000 as at_ms, 'events:' || user_id as key, 's' || (user_id % 10) as session,
    'shard' || (user_id % 3) as shard, user_id, value,
    case when event_type in ('view', 'click') then 'get' when event_type in ('purchase', 'signup') then 'put' else 'delete' end as op,
    (epoch_us(ts) // 1000 - (event_id * 7919 % 11) * 21600000) << 16 as version
  from events
)"""
#: The log's writes as fills and tombstones (CTE `ops`).
OPS_SQL = (
    LOG_SQL
    + """, ops as (
  select seq, at_ms, key, shard, case when op = 'put' then 'fill' else 'tombstone' end as op,
    case when op = 'put' then version end as rv, case when op = 'put' then at_ms << 16 end as fv,
    case when op = 'delete' then version end as version
  from log where op <> 'get'
)"""
)
#: The folded state of ops (CTE `state`).
STATE_SQL = (
    OPS_SQL
    + """, state as (
  select key, rv, fv, tv, coalesce(rv >= coalesce(tv, 0), false) as live from (
    select key, max(case when op = 'fill' then {'rv': rv, 'fv': fv, 'first': -seq} end).rv as rv,
      max(case when op = 'fill' then {'rv': rv, 'fv': fv, 'first': -seq} end).fv as fv, max(version) as tv
    from ops group by key)
)"""
)


def query(name: str, sql: str | None = None):
    """Registers a query, and its SQL."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return f

    return add


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_of(load(spark, sf_dir, "events"))


def log_of(events: DataFrame) -> DataFrame:
    """The log of an events table or stream."""
    kind = F.when(F.col("event_type").isin("view", "click"), "get").when(F.col("event_type").isin("purchase", "signup"), "put").otherwise("delete")
    ms = epoch_ms(F.col("ts"))
    return events.select(
        F.col("event_id").alias("seq"),
        ms.alias("at_ms"),
        F.concat(F.lit("events:"), "user_id").alias("key"),
        F.concat(F.lit("s"), F.col("user_id") % 10).alias("session"),
        F.concat(F.lit("shard"), F.col("user_id") % 3).alias("shard"),
        "user_id",
        "value",
        kind.alias("op"),
        F.shiftleft(ms - (F.col("event_id") * 7919 % 11) * 21_600_000, 16).alias("version"),
    )


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writes_of(log(spark, sf_dir))


def writes_of(rows: DataFrame) -> DataFrame:
    """A log's writes as fills and tombstones."""
    put = F.col("op") == "put"
    return rows.where("op <> 'get'").select("seq", "at_ms", "key", "shard", F.when(put, "fill").otherwise("tombstone").alias("op"), F.when(put, F.col("version")).alias("rv"), F.when(put, F.shiftleft("at_ms", 16)).alias("fv"), F.when(~put, F.col("version")).alias("version"))


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; local sessions that name none get a temporary one."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, for the functions that run in Python there."""
    import os
    import shutil
    import tempfile

    app = spark.sparkContext.applicationId
    if app not in _shipped:
        _shipped.add(app)
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(), "tidemark_core"), "zip", root, "tidemark"))
