"""Queries: comparison of cache and origin, violations, objectives, traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import projection
from ..operators import verifier as V
from .base import LOG_SQL, STATE_SQL, load, log, ops, query, scratch
from .read_queries import MARKED_SQL, marked

HOUR = 3_600_000
BOUND = 2 * HOUR

# A read-through cache whose entries live until the day ends: its entry's version is the last write before midnight.
OBSERVED_SQL = (
    MARKED_SQL
    + """, seen as (
  select *, max(case when op <> 'get' then at_ms << 16 end) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as db,
    at_ms // 86400000 as day from marked
), daily as (
  select *, max(db) over (partition by key, day order by seq rows between unbounded preceding and current row) as top,
    first_value(db) over (partition by key, day order by seq rows between unbounded preceding and current row) as fv from seen where op = 'get'
), obs as (
  select seq, key, shard, at_ms, watermark, fv, db, fv < db as behind from daily where fv is not null and db is not null
), runs as (
  select *, sum(case when behind then 0 else 1 end) over (partition by key order by at_ms, seq rows between unbounded preceding and current row) as run from obs
), timed as (
  select *, case when behind then min(case when behind then at_ms end) over (partition by key, run order by at_ms, seq rows between unbounded preceding and current row) end as since from runs
)"""
)


def observations(spark, d) -> DataFrame:
    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = marked(spark, d).withColumn("db", F.max(F.when(F.col("op") != "get", F.shiftleft("at_ms", 16))).over(before)).where("op = 'get'")
    day = Window.partitionBy("key", F.floor(F.col("at_ms") / 86_400_000)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("fv", F.first("db").over(day)).where("fv is not null and db is not null")
    return rows.select("seq", "key", "shard", "at_ms", "watermark", "fv", "db", (F.col("fv") < F.col("db")).alias("behind"))


@query(
    "compare_version",
    f"""with {STATE_SQL}, o as (select key, max(version) as version from ops where op = 'tombstone' group by key)
    select s.key, s.fv as cache_value, o.version as origin_value, s.fv < o.version as behind from state s join o on s.key = o.key""",
)
def compare_version(spark, d) -> DataFrame:
    from ..operators.state import fold_state

    origin = ops(spark, d).where("op = 'tombstone'").groupBy("key").agg(F.max("version").alias("version"))
    return V.compare(fold_state(ops(spark, d)), origin)


@query("compare_value", "select c_custkey as key, c_mktsegment in ('BUILDING', 'MACHINERY') as behind from customer")
def compare_value(spark, d) -> DataFrame:
    """Byte equality of projected values; the cached copy lacks the segment of some rows."""
    rows = load(spark, d, "customer")
    stale = F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment"))
    cache = rows.select(F.col("c_custkey").alias("key"), projection(F.col("c_name"), stale).alias("fv"))
    origin = rows.select(F.col("c_custkey").alias("key"), projection(F.col("c_name"), F.col("c_mktsegment")).alias("version"))
    return V.compare(cache, origin, "value").select("key", "behind")


@query("behind_since", f"with {OBSERVED_SQL} select seq, key, at_ms, behind, since as behind_since_ms from timed")
def behind_since(spark, d) -> DataFrame:
    return V.behind_since(observations(spark, d)).select("seq", "key", "at_ms", "behind", "behind_since_ms")


JUDGED_SQL = (
    OBSERVED_SQL
    + f""", judged as (
  select seq, key, at_ms, at_ms - since as behind_ms,
    coalesce(behind and at_ms - since > {BOUND}, false) as late, watermark is not null and fv < watermark as low, at_ms - since > {4 * HOUR} + 250 as old
  from timed
)"""
)


def classified(spark, d) -> DataFrame:
    rows = V.behind_since(observations(spark, d)).withColumn("window_ms", F.lit(4 * HOUR))
    return V.classify(rows, BOUND)


@query(
    "classify_violations",
    f"""with {JUDGED_SQL} select seq, key, behind_ms,
      concat_ws(',', case when low then 'SESSION' end, case when old then 'BOUNDED' end, 'EVENTUAL') as levels from judged where late""",
)
def classify_violations(spark, d) -> DataFrame:
    return classified(spark, d).where(F.size("levels") > 0).select("seq", "key", "behind_ms", F.array_join("levels", ",").alias("levels"))


LEVELS_SQL = (
    JUDGED_SQL
    + """, told as (
  select at_ms, 'EVENTUAL' as level, late as violation from judged
  union all select at_ms, 'SESSION', late and coalesce(low, false) from judged
  union all select at_ms, 'BOUNDED', late and coalesce(old, false) from judged
)"""
)
_NINES = "round(case when {v} > 0 then -log10({v} / {n}::double) when {n} > 3 then log10({n} / 3.0) else 0.0 end, 9)"


@query(
    "slo_report",
    f"""with {LEVELS_SQL}, c as (select level, count(*) as n, count_if(violation) as v from told group by level)
    select level, n as observations, cast(v as bigint) as violations, round((n - v) / n::double, 9) as consistency, {_NINES.format(v="v", n="n")} as nines from c""",
)
def slo_report(spark, d) -> DataFrame:
    out = V.slo_report(V.per_level(classified(spark, d)))
    return out.withColumn("consistency", F.round("consistency", 9)).withColumn("nines", F.round("nines", 9))


@query(
    "slo_rolling",
    f"""with {LEVELS_SQL}, w as (
      select level, at_ms, count(*) over r as n, cast(sum(case when violation then 1 else 0 end) over r as bigint) as v from told
      window r as (partition by level order by at_ms range between {6 * HOUR - 1} preceding and current row)
    ) select level, at_ms, n as observations, v as violations, {_NINES.format(v="v", n="n")} as nines from w""",
)
def slo_rolling(spark, d) -> DataFrame:
    out = V.slo_rolling(V.per_level(classified(spark, d), "version", "at_ms"), 6 * HOUR)
    return out.select("level", "at_ms", "observations", "violations", F.round("nines", 9).alias("nines"))


@query("trace_last_n", f"with {LOG_SQL}, r as (select *, row_number() over (partition by key order by at_ms desc, seq desc) as r from log) select key, seq, op, cast(r as integer) as rank from r where r <= 8")
def trace_last_n(spark, d) -> DataFrame:
    return V.trace(log(spark, d), 8).select("key", "seq", "op", "rank")


@query(
    "violation_traces",
    f"""with {JUDGED_SQL}, r as (select *, row_number() over (partition by key order by at_ms desc, seq desc) as r from log where op <> 'get'
    ), t as (select key, string_agg(seq || ':' || op, ',' order by at_ms, seq) as trace from r where r <= 4 group by key)
    select j.seq, j.key, t.trace from judged j left join t on j.key = t.key where late""",
)
def violation_traces(spark, d) -> DataFrame:
    bad = classified(spark, d).where(F.size("levels") > 0).select("seq", "key")
    out = V.violation_traces(bad, log(spark, d).where("op <> 'get'"), 4)
    return out.select("seq", "key", F.array_join(F.transform("trace", lambda x: F.concat_ws(":", x["seq"], x["op"])), ",").alias("trace"))


STATS_SQL = JUDGED_SQL + """, stats as (
  select shard, count(distinct seq // 100) as rounds, count(*) as checked, cast(sum(case when late then 1 + low::int + old::int else 0 end) as bigint) as violations, 0 as errors
  from judged join (select seq as s, shard from log) on s = seq group by shard
)"""


def stats(spark, d) -> DataFrame:
    rows = classified(spark, d).withColumn("round", F.floor(F.col("seq") / 100))
    return V.round_stats(rows, "shard")


@query("round_stats", f"with {STATS_SQL} select shard, rounds, checked, violations, cast(errors as bigint) as errors from stats")
def round_stats(spark, d) -> DataFrame:
    return stats(spark, d)


@query("false_positive_rate", f"with {STATS_SQL} select shard, checked, violations, round(violations / checked::double, 9) as rate, violations / checked::double <= 0.01 as acceptable, true as shadow_mode from stats")
def false_positive_rate(spark, d) -> DataFrame:
    out = V.shadow(V.false_positive_rate(stats(spark, d)))
    return out.select("shard", "checked", "violations", F.round("rate", 9).alias("rate"), "acceptable", "shadow_mode")


@query("sampling_rounds", "select 'entities:' || c_custkey as key, c_custkey // 100 as round, c_custkey // 100 * 1000 as at_ms from customer")
def sampling_rounds(spark, d) -> DataFrame:
    keys = load(spark, d, "customer").select(F.concat(F.lit("entities:"), "c_custkey").alias("key"), F.col("c_custkey").alias("i"))
    return V.sampling_rounds(keys)


@query("stream_behind", f"with {OBSERVED_SQL} select seq, key, at_ms, since as behind_since_ms from timed")
def stream_behind(spark, d) -> DataFrame:
    """The behind timer over a stream of observations: the same as the batch form."""
    from ..streaming import folds, stateful

    folder, out = scratch(spark, "observations"), scratch(spark, "stream-behind")
    rows = observations(spark, d).select("key", "at_ms", "seq", "behind")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(folder)
    folds.run_once(stateful.behind_stream(stream), out, scratch(spark, "stream-checkpoint"), "append")
    return spark.read.schema("key string, at_ms long, seq long, behind_since_ms long").parquet(f"{out}/*").select("seq", "key", "at_ms", "behind_since_ms")


@query(
    "inspect_keys",
    f"""with {STATE_SQL}, o as (select key, max(version) as version from ops where op = 'tombstone' and seq % 3 <> 0 group by key), e as (select key, rv, fv from state where live)
    select k.key, e.rv, e.fv, o.version as origin_version, case when e.rv is null and o.version is null then 'absent' when e.rv is null then 'not_cached' when o.version is null then 'orphaned' when e.rv < o.version then 'behind' else 'current' end as state
    from (select distinct key from log) k left join e on e.key = k.key left join o on o.key = k.key""",
)
def inspect_keys(spark, d) -> DataFrame:
    from ..operators.state import fold_state

    origin = ops(spark, d).where("op = 'tombstone' and seq % 3 <> 0").groupBy("key").agg(F.max("version").alias("version"))
    return V.inspect(log(spark, d), fold_state(ops(spark, d)), origin)
