"""Queries: sessions, freshness, reads, writes, leases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import reads as R
from ..operators import sessions as W
from ..operators import state as S
from .base import LOG_SQL, STATE_SQL, load, log, ops, query

MARKED_SQL = (
    LOG_SQL
    + """, marked as (
  select *, max(case when op <> 'get' then version end) over (partition by session, shard order by seq rows between unbounded preceding and 1 preceding) as watermark from log
)"""
)


def marked(spark, d) -> DataFrame:
    return W.watermarks_before(log(spark, d), advances=F.col("op") != "get")


@query("session_watermark", f"with {MARKED_SQL} select seq, session, shard, watermark from marked where op = 'get'")
def session_watermark(spark, d) -> DataFrame:
    return marked(spark, d).where("op = 'get'").select("seq", "session", "shard", "watermark")


@query(
    "session_tokens",
    f"""with {LOG_SQL}, m as (
      select session, shard, max(version) as w from log where op <> 'get' group by session, shard
    ), r as (
      select *, row_number() over (partition by session order by w desc, shard) as r from m
    ) select session, string_agg(shard || ':' || w, ',' order by shard) as token from r where r <= 2 group by session""",
)
def session_tokens(spark, d) -> DataFrame:
    marks = W.session_tokens(log(spark, d).where("op <> 'get'"), most=2)
    return marks.groupBy("session").agg(C.encode_session(F.map_from_entries(F.collect_list(F.struct("shard", "watermark")))).alias("token"))


@query(
    "session_merge",
    f"""with {LOG_SQL}, m as (
      select session, shard, max(case when seq % 2 = 0 then version end) as a, max(case when seq % 2 = 1 then version end) as b from log where op <> 'get' group by session, shard
    ) select session, string_agg(shard || ':' || greatest(a, b), ',' order by shard) as token from m group by session""",
)
def session_merge(spark, d) -> DataFrame:
    """Two clients' tokens of one session, encoded, decoded and merged shard by shard."""
    writes = log(spark, d).where("op <> 'get'")

    def token(odd: int, name: str) -> DataFrame:
        marks = writes.where(F.col("seq") % 2 == odd).groupBy("session", "shard").agg(F.max("version").alias("v"))
        return marks.groupBy("session").agg(C.encode_session(F.map_from_entries(F.collect_list(F.struct("shard", "v")))).alias(name))

    both = token(0, "a").join(token(1, "b"), "session", "full")
    empty = F.lit("")
    return both.select("session", C.encode_session(C.merge_sessions(C.decode_session(F.coalesce("a", empty)), C.decode_session(F.coalesce("b", empty)))).alias("token"))


CACHED_SQL = MARKED_SQL + """, cached as (
  select *, max(case when op = 'put' and seq % 4 <> 0 then at_ms << 16 end) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as fv from marked
)"""


def cached_reads(spark, d) -> DataFrame:
    """Reads with their watermark and the fill version of a cache that misses every fourth write."""
    from pyspark.sql import Window

    before = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    fill = F.when((F.col("op") == "put") & (F.col("seq") % 4 != 0), F.shiftleft("at_ms", 16))
    return marked(spark, d).withColumn("fv", F.max(fill).over(before)).where("op = 'get' and fv is not null")


_SESSION = "(watermark is null or fv >= watermark)"
_BOUND = 2 * 86_400_000
_TESTS = {"strong": "false", "session": _SESSION, "bounded": f"{_SESSION} and (fv >> 16) >= at_ms - {_BOUND} + 250", "eventual": "true"}


def _accept(level: str):
    @query(f"read_accept_{level}", f"with {CACHED_SQL} select seq, key, {_TESTS[level]} as accepted from cached where op = 'get' and fv is not null")
    def run(spark, d) -> DataFrame:
        return W.accept_reads(cached_reads(spark, d), level.upper(), _BOUND).select("seq", "key", "accepted")

    return run


for _level in _TESTS:
    _accept(_level)

_LEVEL_SQL = "case seq % 4 when 0 then 'STRONG' when 1 then 'SESSION' when 2 then 'BOUNDED' else 'EVENTUAL' end"
RESOLVED_SQL = MARKED_SQL + STATE_SQL.removeprefix(LOG_SQL) + f""", origin as (
  select key, version from (select key, op, version, row_number() over (partition by key order by seq desc) as r from log where op <> 'get') where r = 1 and op = 'put'
), j as (
  select m.seq, m.key, {_LEVEL_SQL} as level, s.live is not null as present, s.rv, s.key in (select key from state where tv is not null and tv % 3 = 0) as negative, o.version as ov,
    case seq % 4 when 0 then false when 1 then (watermark is null or fv >= watermark) when 2 then (watermark is null or fv >= watermark) and (fv >> 16) >= at_ms - {_BOUND} + 250 else true end as fresh
  from marked m left join (select * from state where live) s on m.key = s.key left join origin o on m.key = o.key where m.op = 'get'
), resolved as (
  select seq, key, level, case when level = 'STRONG' then 'bypass' when present and coalesce(fresh, false) and coalesce(negative, false) then 'negative_hit' when present and coalesce(fresh, false) then 'hit' when present then 'stale' else 'miss' end as outcome, ov, rv from j
)"""


def resolved(spark, d) -> DataFrame:
    level = F.when(F.col("seq") % 4 == 0, "STRONG").when(F.col("seq") % 4 == 1, "SESSION").when(F.col("seq") % 4 == 2, "BOUNDED").otherwise("EVENTUAL")
    requests = marked(spark, d).where("op = 'get'").withColumn("level", level).withColumn("bound_ms", F.lit(_BOUND))
    entries = S.fold_state(ops(spark, d)).withColumn("negative", F.coalesce(F.col("tv") % 3 == 0, F.lit(False)))
    last = log(spark, d).where("op <> 'get'").groupBy("key").agg(F.max_by(F.struct("op", "version"), "seq").alias("w"))
    origin = last.where("w.op = 'put'").select("key", F.col("w.version").alias("version"))
    return R.resolve_reads(requests, entries, origin)


@query(
    "resolve_reads",
    f"""with {RESOLVED_SQL} select seq, key, level, outcome,
      case outcome when 'hit' then true when 'negative_hit' then false else ov is not null end as found,
      cast(case outcome when 'hit' then rv when 'negative_hit' then 0 else coalesce(ov, 0) end as bigint) as row_version,
      outcome in ('hit', 'negative_hit') as cache_hit, outcome in ('stale', 'miss') as filled from resolved""",
)
def resolve_reads(spark, d) -> DataFrame:
    return resolved(spark, d)


@query("batch_get", "select c_custkey, c_name, c_acctbal from customer where c_custkey in (select distinct o_custkey from orders where o_orderpriority like '1%')")
def batch_get(spark, d) -> DataFrame:
    keys = load(spark, d, "orders").where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    return R.batch_get(keys, load(spark, d, "customer"), "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query("batch_missing", "select distinct user_id * 11 as c_custkey from events where user_id * 11 not in (select c_custkey from customer)")
def batch_missing(spark, d) -> DataFrame:
    keys = load(spark, d, "events").select((F.col("user_id") * 11).alias("c_custkey"))
    return R.batch_missing(keys, load(spark, d, "customer"), "c_custkey")


@query("shard_groups", "select 'shard' || (o_custkey % 3) as shard, count(distinct o_custkey) as n_keys, count(*) as asked from orders group by 1")
def shard_groups(spark, d) -> DataFrame:
    keys = load(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return R.shard_groups(keys, F.concat(F.lit("shard"), F.col("key") % 3))


def _update(name: str, budget: int):
    @query(
        name,
        f"""with m as (select o_custkey % 3 as shard, o_orderkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'
        ), c as (select shard, count(*) as matched, count(*) > {budget} as degraded, string_agg(cast(o_orderkey as varchar), ',' order by o_orderkey) as keys from m group by shard
        ) select shard, matched, degraded, case when max(degraded) over () then '' else keys end as keys from c""",
    )
    def run(spark, d) -> DataFrame:
        rows = load(spark, d, "orders").withColumn("shard", F.col("o_custkey") % 3)
        out = R.update_where(rows, (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), "o_orderkey", budget)
        return out.select("shard", "matched", "degraded", F.array_join("keys", ",").alias("keys"))

    return run


_update("update_where", 1_000_000)
_update("update_where_degraded", 20)


@query(
    "monotonic_reads_check",
    f"""with {LOG_SQL}, r as (
      select seq, session, key, version, max(version) over (partition by session, key order by seq rows between unbounded preceding and 1 preceding) as seen from log where op = 'get'
    ) select seq, session, key, version, seen from r where version < seen""",
)
def monotonic_reads_check(spark, d) -> DataFrame:
    return W.non_monotonic_reads(log(spark, d).where("op = 'get'"), "version").select("seq", "session", "key", "version", "seen")


@query(
    "lease_outcomes",
    f"""with recursive {LOG_SQL}, e as (
      select seq, key, at_ms, op = 'put' as fill, row_number() over (partition by key order by at_ms, seq) as i from log where op in ('get', 'put')
    ), s as (
      select key, i, seq, at_ms, fill, case when not fill then at_ms end as grant_ms, not fill as granted from e where i = 1
      union all
      select e.key, e.i, e.seq, e.at_ms, e.fill, case when e.fill then null when s.grant_ms is null or e.at_ms - s.grant_ms >= 14400000 then e.at_ms else s.grant_ms end,
        not e.fill and (s.grant_ms is null or e.at_ms - s.grant_ms >= 14400000)
      from s join e on e.key = s.key and e.i = s.i + 1
    ) select seq, key, at_ms - grant_ms as since_ms, case when granted then 'granted' when at_ms - grant_ms <= 75 then 'waited' else 'wait_exhausted' end as outcome from s where not fill""",
)
def lease_outcomes(spark, d) -> DataFrame:
    """Leases of four hours; a put of the key is its holder's fill."""
    rows = log(spark, d)
    return R.lease_outcomes(rows.where("op = 'get'"), 14_400_000, fills=rows.where("op = 'put'")).select("seq", "key", "since_ms", "outcome")


@query(
    "gated_reads",
    f"""with {RESOLVED_SQL}, g as (
      select seq, key, level, outcome, case when level = 'STRONG' then 'strong' when cast(split_part(key, ':', 2) as bigint) % 7 = 0 then 'not_admitted'
        when seq * 7919 % 1000 / 1000.0 < case when seq % 3 = 0 then 0.25 else 0.0 end then 'shed' end as gate from resolved
    ) select seq, key, level as level_served, gate is null and outcome in ('hit', 'negative_hit') as cache_hit, coalesce(gate, outcome) as reason,
      gate is null and outcome in ('stale', 'miss') as filled,
      cast(case when gate is null and outcome in ('hit', 'negative_hit') and level = 'BOUNDED' then {_BOUND} - 250 end as bigint) as staleness_bound_ms from g""",
)
def gated_reads(spark, d) -> DataFrame:
    """Reads past the admission gate (every seventh key isn't admitted) and the breaker's (a quarter of some reads is shed)."""
    admitted = F.element_at(F.split("key", ":"), 2).cast("long") % 7 != 0
    shed = F.when(F.col("seq") % 3 == 0, 0.25).otherwise(0.0)
    return R.gated(resolved(spark, d), admitted, shed, F.col("seq") * 7919 % 1000 / 1000.0, F.lit(_BOUND))


@query("standby_state", f"with {STATE_SQL.replace('from ops group by key', 'from ops where seq % 5 = 0 group by key')} select key, rv, fv, tv, live from state")
def standby_state(spark, d) -> DataFrame:
    """What the standby pool holds: the writes made while the home pool was down, folded."""
    return S.fold_state(R.standby_ops(ops(spark, d), F.col("seq") % 5 != 0)).select("key", "rv", "fv", "tv", "live")


@query("valid_matches", "select o_orderkey, o_orderkey % 4 = 0 or o_orderkey % 4 = 3 as declared from orders")
def valid_matches(spark, d) -> DataFrame:
    """Conditional writes whose columns are declared (in any order), lack one, or repeat one."""
    asked = [(["tenant_id", "status"], ["payload"]), (["tenant_id"], ["payload"]), (["tenant_id", "status", "status"], ["payload"]), (["status", "tenant_id"], ["payload"])]
    pick = lambda i: F.get(F.array(*(F.array(*map(F.lit, a[i])) for a in asked)), (F.col("o_orderkey") % 4).cast("int"))
    rows = load(spark, d, "orders").select("o_orderkey", pick(0).alias("match_columns"), pick(1).alias("set_columns"))
    return R.valid_matches(rows, [(["tenant_id", "status"], ["payload"])]).select("o_orderkey", "declared")


@query(
    "standby_reads",
    f"""with {RESOLVED_SQL}, b as (
      select r.seq, r.key, outcome in ('hit', 'negative_hit') as cache_hit, r.seq % 5 <> 0 as up, s.key is not null as in_standby
      from resolved r left join (select key from state where live and fv % 3 = 0) s on r.key = s.key
    ), w as (
      select seq, key, case when up then case when cache_hit then 'cache' else 'origin' end when in_standby then 'standby' else 'origin' end as served_by from b
    ) select seq, key, served_by, served_by = 'standby' as degraded, cast(case when served_by = 'standby' then 30000 end as integer) as staleness_bound_ms from w""",
)
def standby_reads(spark, d) -> DataFrame:
    standby = S.fold_state(ops(spark, d)).where("fv % 3 = 0")
    out = R.with_standby(resolved(spark, d), standby, F.col("seq") % 5 != 0)
    return out.select("seq", "key", "served_by", "degraded", "staleness_bound_ms")


@query(
    "delete_results",
    f"""with {LOG_SQL}, r as (
      select *, last_value(case when op <> 'get' then op end ignore nulls) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as before from log
    ) select seq, key, coalesce(before = 'put', false) as existed, cast(case when before = 'put' then version else 0 end as bigint) as version from r where op = 'delete'""",
)
def delete_results(spark, d) -> DataFrame:
    return R.delete_results(log(spark, d)).select("seq", "key", "existed", "version")
