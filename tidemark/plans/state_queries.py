"""Queries: versioned state, clocks, keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.schema import ColumnSpec, TableSpec
from ..operators import state as S
from .base import LOG_SQL, OPS_SQL, STATE_SQL, load, log, ops, query, scratch

ENTITIES = TableSpec("entities", tuple(ColumnSpec(*c) for c in (("id", "uint64"), ("tenant_id", "uint32"), ("status", "uint8"), ("payload", "bytes"), ("version", "uint64"))), ("id",), "version")
GADGETS = TableSpec("gadgets", (ColumnSpec("sku", "string", False, "utf8mb4_bin"), ColumnSpec("region", "string"), ColumnSpec("price", "text"), ColumnSpec("note", "text", True), ColumnSpec("row_version", "uint64")), ("sku",), "row_version")


@query("state_fold", f"with {STATE_SQL} select key, rv, fv, tv, live from state")
def state_fold(spark, d) -> DataFrame:
    return S.fold_state(ops(spark, d)).select("key", "rv", "fv", "tv", "live")


APPLIED_SQL = """
run as (
  select *, max(case when op = 'fill' then {'rv': rv, 'fv': fv} end) over w as pf, max(version) over w as pt
  from ops window w as (partition by key order by seq rows between unbounded preceding and 1 preceding)
), applied as (
  select seq, key, op, rv, version, case when op = 'fill' then rv >= coalesce(pt, 0) and (pf is null or {'rv': rv, 'fv': fv} > pf)
    else version > coalesce(pf.rv, -1) and version > coalesce(pt, 0) end as applied
  from run
)"""


@query("state_applied", f"with {OPS_SQL}, {APPLIED_SQL} select seq, key, op, applied from applied")
def state_applied(spark, d) -> DataFrame:
    return S.replay_applied(ops(spark, d)).select("seq", "key", "op", "applied")


DAY = 86_400_000
#: Each key's operations one after another: an entry ends a day after the last write that won (CTE `epochs`).
EPOCHS_SQL = (
    OPS_SQL
    + f""", o as (select *, row_number() over (partition by key order by seq) as i from ops), epochs as (
  select key, i, seq, 1 as epoch, rv, case when rv is not null then fv end as fv, version as tv, at_ms + {DAY} as ends, true as applied from o where i = 1
  union all
  select key, i, seq, epoch, case when not won then rv when op = 'fill' then nrv end, case when not won then fv when op = 'fill' then nfv end,
    case when won and op = 'tombstone' then nver else tv end, case when won then at_ms + {DAY} else ends end, won
  from (
    select *, case when op = 'fill' then nrv >= coalesce(tv, 0) and (rv is null or nrv > rv or (nrv = rv and nfv > fv)) else nver > coalesce(rv, -1) and nver > coalesce(tv, 0) end as won
    from (
      select o.key, o.i, o.seq, o.op, o.at_ms, o.rv as nrv, o.fv as nfv, o.version as nver, e.epoch + case when o.at_ms >= e.ends then 1 else 0 end as epoch,
        case when o.at_ms < e.ends then e.rv end as rv, case when o.at_ms < e.ends then e.fv end as fv, case when o.at_ms < e.ends then e.tv end as tv, case when o.at_ms < e.ends then e.ends end as ends
      from epochs e join o on o.key = e.key and o.i = e.i + 1))
)"""
)


@query("state_expiry_epochs", f"with recursive {EPOCHS_SQL} select seq, key, cast(epoch as bigint) as epoch, applied from epochs")
def state_expiry_epochs(spark, d) -> DataFrame:
    return S.expiry_epochs(ops(spark, d), DAY).select("seq", "key", "epoch", "applied")


@query("stream_expiry", f"with recursive {EPOCHS_SQL} select seq, key, cast(epoch as bigint) as epoch, applied from epochs")
def stream_expiry(spark, d) -> DataFrame:
    """The same over a stream, with the entries as its state."""
    from ..streaming import folds, stateful

    folder, out = scratch(spark, "ops"), scratch(spark, "stream-expiry")
    rows = ops(spark, d).select("key", "seq", "op", "at_ms", "rv", "fv", "version")
    rows.write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1000).parquet(folder)
    folds.run_once(stateful.expiring_stream(stream, DAY), out, scratch(spark, "stream-checkpoint"), "append")
    return spark.read.schema("key string, seq long, epoch long, applied boolean").parquet(f"{out}/*").select("seq", "key", "epoch", "applied")


NOW = 1_705_000_000_000
#: The current entries with the fingerprint and the end of the fill that wrote them.
ENTRY_SQL = OPS_SQL + f""", w as (
  select key, -max(case when op = 'fill' then {{'rv': rv, 'fv': fv, 'first': -seq}} end).first as seq, max(version) as tv from ops group by key
), entry as (
  select w.key, o.rv, case when o.seq % 3 = 0 then 'old' else 'new' end as fingerprint, o.at_ms + {20 * DAY} as expires_at_ms, coalesce(o.rv >= coalesce(w.tv, 0), false) as live
  from w join ops o on o.seq = w.seq
)"""


def entries(spark, d) -> DataFrame:
    rows = ops(spark, d).withColumn("fingerprint", F.when(F.col("seq") % 3 == 0, "old").otherwise("new")).withColumn("expires_at_ms", F.col("at_ms") + 20 * DAY)
    return S.fold_state(rows)


@query("readable_entries", f"with {ENTRY_SQL} select key, rv from entry where live and fingerprint = 'new' and expires_at_ms > {NOW}")
def readable_entries(spark, d) -> DataFrame:
    return S.readable(entries(spark, d), "new", NOW).select("key", "rv")


@query("remaining_ttl", f"with {ENTRY_SQL} select k.key, cast(case when live and expires_at_ms > {NOW} then expires_at_ms - {NOW} else -2 end as bigint) as ttl_ms, false as endless from (select distinct key from log) k left join entry e on e.key = k.key")
def remaining_ttl(spark, d) -> DataFrame:
    return S.remaining_ttl(log(spark, d), entries(spark, d).where("live"), NOW)


@query(
    "hlc_stamp",
    f"""with {LOG_SQL}, c as (
      select seq, shard, case op when 'put' then 'next' when 'get' then 'now' else 'observe' end as clock,
        case when op = 'delete' then version else (at_ms // 3600000 * 3600000) << 16 end as cand
      from log
    ), n as (
      select *, sum(case when clock = 'next' then 1 else 0 end) over (partition by shard order by seq rows between unbounded preceding and current row) as n from c
    ), h as (
      select seq, shard, clock, cast(n + greatest(0, max(cand - n) over (partition by shard order by seq rows between unbounded preceding and current row)) as bigint) as hlc from n
    ) select seq, shard, clock, hlc, hlc >> 16 as ms, hlc & 65535 as logical from h""",
)
def hlc_stamp(spark, d) -> DataFrame:
    rows = log(spark, d).select("seq", "shard", F.when(F.col("op") == "put", "next").when(F.col("op") == "get", "now").otherwise("observe").alias("clock"), (F.floor(F.col("at_ms") / 3_600_000) * 3_600_000).alias("wall_ms"), F.col("version").alias("v"))
    out = S.stamp_hlc(rows)
    return out.select("seq", "shard", "clock", "hlc", C.hlc_ms(F.col("hlc")).alias("ms"), C.hlc_logical(F.col("hlc")).alias("logical"))


ESCAPED_SQL = "replace(replace({0}, '%', '%25'), ':', '%3A')"


@query(
    "key_format",
    f"select p_partkey, 'parts:' || {ESCAPED_SQL.format('p_brand')} || ':' || {ESCAPED_SQL.format('''p_name || ':100%' ''')} as key from part",
)
def key_format(spark, d) -> DataFrame:
    rows = load(spark, d, "part")
    return rows.select("p_partkey", C.format_key("parts", F.col("p_brand"), F.concat("p_name", F.lit(":100%"))).alias("key"))


@query("key_parse", "select p_partkey, 'parts' as table_name, p_brand as brand, p_name || ':100%' as name, true as valid from part")
def key_parse(spark, d) -> DataFrame:
    rows = key_format(spark, d)
    p = C.parse_key(F.col("key"))
    return rows.select("p_partkey", p["table"].alias("table_name"), p["parts"][0].alias("brand"), p["parts"][1].alias("name"), C.valid_key(F.col("key")).alias("valid"))


@query(
    "schema_fingerprint",
    " union all ".join(f"select '{t.name}' as table_name, substr(sha256('{t.canonical}'), 1, 16) as fingerprint" for t in (ENTITIES, GADGETS)),
)
def schema_fingerprint(spark, d) -> DataFrame:
    rows = spark.createDataFrame([(t.name, t.canonical) for t in (ENTITIES, GADGETS)], "table_name string, canonical string")
    return rows.select("table_name", F.substring(F.sha2("canonical", 256), 1, 16).alias("fingerprint"))


@query("version_text", f"with {LOG_SQL} select seq, lpad(cast(version as varchar), 20, '0') as padded, version >> 16 as ms, version & 65535 as logical from log")
def version_text(spark, d) -> DataFrame:
    v = F.col("version")
    return log(spark, d).select("seq", C.padded_version(v).alias("padded"), C.hlc_ms(v).alias("ms"), C.hlc_logical(v).alias("logical"))


@query(
    "latest_version_dedupe",
    """select l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice from (
      select *, row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc, l_partkey desc, l_suppkey desc, l_quantity desc, l_extendedprice desc) as r from lineitem
    ) where r = 1""",
)
def latest_version_dedupe(spark, d) -> DataFrame:
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return S.latest_by_key(rows, ["l_orderkey", "l_linenumber"], "l_shipdate", ["l_partkey", "l_suppkey"])


@query(
    "lost_invalidations",
    f"""with {OPS_SQL}, {APPLIED_SQL}, h as (
      select a.*, max(case when op = 'fill' then rv end) over (partition by key order by seq rows between unbounded preceding and 1 preceding) as held_rv from applied a
    ) select seq, key, version, held_rv from h where op = 'tombstone' and not applied""",
)
def lost_invalidations(spark, d) -> DataFrame:
    return S.lost_invalidations(ops(spark, d))


@query(
    "invalidations",
    f"""with {LOG_SQL}, b as (
      select key, version, 'write_path' as source from log where op in ('put', 'delete') and seq % 3 <> 0
      union all select key, version, 'cdc' as source from log where op in ('put', 'delete') and seq % 4 <> 0
    ) select key, version, string_agg(distinct source, '+' order by source) as sources from b group by key, version""",
)
def invalidations(spark, d) -> DataFrame:
    writes = log(spark, d).where("op in ('put', 'delete')")
    out = S.invalidations(writes.where("seq % 3 <> 0"), writes.where("seq % 4 <> 0"))
    return out.select("key", "version", F.array_join("sources", "+").alias("sources"))


@query(
    "change_keys",
    """with e as (select event_id, 'events:' || user_id as b, 'events:' || (case when event_id % 5 = 0 then user_id + 1 else user_id end) as a, event_id % 7 as version from events)
    select k as key, cast(version as bigint) as version, count(*) as n from (
      select b as k, version from e where version > 0 union all select a as k, version from e where version > 0 and a <> b
    ) group by k, version""",
)
def change_keys(spark, d) -> DataFrame:
    after = F.when(F.col("event_id") % 5 == 0, F.col("user_id") + 1).otherwise(F.col("user_id"))
    events = load(spark, d, "events").select(F.concat(F.lit("events:"), "user_id").alias("key_before"), F.concat(F.lit("events:"), after).alias("key_after"), (F.col("event_id") % 7).alias("version"))
    return S.change_keys(events).groupBy("key", "version").agg(F.count("*").alias("n"))


@query(
    "checkpoint_freeze",
    f"""with {LOG_SQL}, e as (
      select shard, 'bin.' || lpad(cast(seq // 1000 as varchar), 6, '0') as file, seq % 1000 as "offset", not (seq % 997 = 500 and shard <> 'shard1') as delivered from log
    ), x as (
      select shard, min(case when not delivered then {{'f': file, 'o': "offset"}} end) as stuck, max({{'f': file, 'o': "offset"}}) as last from e group by shard
    ) select shard, coalesce(stuck, last).f as file, coalesce(stuck, last).o as "offset", stuck is not null as frozen from x""",
)
def checkpoint_freeze(spark, d) -> DataFrame:
    rows = log(spark, d).select("shard", F.concat(F.lit("bin."), F.lpad(F.floor(F.col("seq") / 1000).cast("string"), 6, "0")).alias("file"), (F.col("seq") % 1000).alias("offset"), (~((F.col("seq") % 997 == 500) & (F.col("shard") != "shard1"))).alias("delivered"))
    return S.frozen_position(rows)
