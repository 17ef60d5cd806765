"""Queries: admission, breakers, telemetry, reports, placement, statements, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..operators import reports as P
from ..operators import ring, statements
from ..operators import telemetry as T
from ..operators import traffic as A
from ..sources import generate, text
from ..streaming import folds, stateful
from .base import LOG_SQL, STATE_SQL, load, log, log_of, query, scratch, writes_of
from .read_queries import RESOLVED_SQL, resolved

HOUR = 3_600_000

RATIO_SQL = (
    LOG_SQL
    + f""", slices as (
  select key, at_ms // {24 * HOUR} as slice, count_if(op = 'get') as r, count_if(op <> 'get') as w from log group by 1, 2
), ratios as (
  select key, slice, cast(sum(r) over f as bigint) as reads, cast(sum(w) over f as bigint) as writes from slices
  window f as (partition by key order by slice range between 5 preceding and current row)
), rated as (select *, case when writes > 0 then reads / writes::double when reads > 0 then 1e9 else 0.0 end as ratio from ratios)"""
)


def ratios(spark, d) -> DataFrame:
    return A.read_write_ratio(log(spark, d), 24 * HOUR, 6)


@query("admission_ratio", f"with {RATIO_SQL} select key, slice, reads, writes, round(ratio, 9) as ratio from rated")
def admission_ratio(spark, d) -> DataFrame:
    finite = F.when(F.col("ratio") == float("inf"), F.lit(1e9)).otherwise(F.col("ratio"))
    return ratios(spark, d).select("key", "slice", "reads", "writes", F.round(finite, 9).alias("ratio"))


@query(
    "admission_hysteresis",
    f"""with {RATIO_SQL}, f as (
      select *, reads + writes >= 8 as known, case when reads + writes < 8 then null when ratio >= 0.9 then true when ratio < 0.6 then false end as forced from rated
    ) select key, slice, case when known then coalesce(last_value(forced ignore nulls) over (partition by key order by slice rows between unbounded preceding and current row), true) else true end as admitted from f""",
)
def admission_hysteresis(spark, d) -> DataFrame:
    return A.admission(ratios(spark, d), 0.9, 0.6, 8).select("key", "slice", "admitted")


@query(
    "breaker_shed",
    f"""with {LOG_SQL}, s as (
      select shard, at_ms // {HOUR} as slice, count(*) as n, count_if(op = 'delete') as f from log group by 1, 2
    ), w as (
      select shard, slice, cast(sum(n) over r as bigint) as requests, cast(sum(f) over r as bigint) as failures from s
      window r as (partition by shard order by slice range between 9 preceding and current row)
    ) select shard, slice, requests, failures, round(case when requests < 20 or failures / requests::double <= 0.05 then 0.0
      else least(0.95, (failures / requests::double - 0.05) / 0.95 * 0.95) end, 9) as shed from w""",
)
def breaker_shed(spark, d) -> DataFrame:
    out = A.breaker(log(spark, d).withColumn("failed", F.col("op") == "delete"), "shard", HOUR, 10)
    return out.withColumn("shed", F.round("shed", 9))


# FNV-1a and the finaliser in unsigned 128-bit arithmetic modulo 2 ** 64.
_M = "18446744073709551616::uhugeint"
_FNV = f"list_reduce(list_prepend({H.FNV_OFFSET}::uhugeint, list_transform(range(1, len({{0}}) + 1), lambda i: ord(substr({{0}}, i, 1))::uhugeint)), lambda h, b: (xor(h::ubigint, b::ubigint)::uhugeint * {H.FNV_PRIME}::uhugeint) % {_M})"


def _splitmix_sql(h: str) -> list[str]:
    return [
        f"(({h}) + {H.GOLDEN}::uhugeint) % {_M} as z0",
        f"(xor(z0::ubigint, (z0 // 1073741824::uhugeint)::ubigint)::uhugeint * {H.MIX_1}::uhugeint) % {_M} as z1",
        f"(xor(z1::ubigint, (z1 // 134217728::uhugeint)::ubigint)::uhugeint * {H.MIX_2}::uhugeint) % {_M} as z2",
        "xor(z2::ubigint, (z2 // 2147483648::uhugeint)::ubigint)::uhugeint as h",
    ]


def _hashed_sql(source: str, name: str) -> str:
    a, b, c, e = _splitmix_sql(_FNV.format("t"))
    return f"{name}0 as (select *, {a} from ({source})), {name}1 as (select *, {b} from {name}0), {name}2 as (select *, {c} from {name}1), {name} as (select *, {e} from {name}2)"


_KEYS = "select distinct 'entities:' || c_custkey as t from customer"
NODES = ["shard0", "shard1", "shard2"]


def _keys(spark, d) -> DataFrame:
    return load(spark, d, "customer").select(F.concat(F.lit("entities:"), "c_custkey").alias("key")).distinct()


@query("ring_hash", f"with {_hashed_sql(_KEYS, 'k')} select t as key, lower(lpad(to_hex(h::ubigint), 16, '0')) as hash, cast({_FNV.format('t')} % 3 as bigint) as plain_shard from k")
def ring_hash(spark, d) -> DataFrame:
    return _keys(spark, d).select("key", H.ring_hash_hex(F.col("key")).alias("hash"), H.plain_shard(F.col("key"), 3).alias("plain_shard"))


def _placed_sql(name: str, nodes: list[str]) -> str:
    points = _hashed_sql(f"select n || '#' || i as t, n from (select unnest({nodes}) as n) cross join (select unnest(range(256)) as i)", f"{name}p")
    return f"""{points}, {name}best as (select k.t, min(case when p.h >= k.h then p.h end) as up, min(p.h) as low from k cross join {name}p p group by k.t),
    {name} as (select b.t, p.n as node from {name}best b join {name}p p on p.h = coalesce(up, low))"""


@query(
    "ring_share",
    f"""with {_hashed_sql(_KEYS, "k")}, {_placed_sql("own", NODES)}, c as (select node, count(*) as n_keys from own group by node)
    select node, n_keys, round(n_keys / (sum(n_keys) over ())::double, 9) as share from c""",
)
def ring_share(spark, d) -> DataFrame:
    return ring.ring_share(_keys(spark, d), NODES).withColumn("share", F.round("share", 9))


@query("ring_moves", f"""with {_hashed_sql(_KEYS, "k")}, {_placed_sql("x", NODES)}, {_placed_sql("y", [*NODES, "shard3"])}
    select x.node as old, y.node as new, count(*) as n_keys from x join y on x.t = y.t where x.node <> y.node group by 1, 2""")
def ring_moves(spark, d) -> DataFrame:
    return ring.ring_moves(_keys(spark, d), NODES, [*NODES, "shard3"])


@query("locate_keys", f"""with {_hashed_sql(_KEYS, "k")}, {_placed_sql("own", NODES)} select t as key, node from own""")
def locate_keys(spark, d) -> DataFrame:
    return ring.placed(_keys(spark, d), NODES)


@query(
    "quick_bench",
    f"""with {LOG_SQL}, b as (select *, lag(op) over (partition by key order by seq) as was from log),
    r as (select *, coalesce(was <> 'delete', false) as hit, case when was <> 'delete' then 500 else 5000 end as us from b where op = 'get')
    select count_if(hit) as hits, count(*) as reads, round(count_if(hit) / count(*)::double, 9) as hit_rate, round(count_if(not hit) / ((max(at_ms) - min(at_ms)) / 1000.0), 9) as origin_qps,
      quantile_disc(us, 0.5) as p50, quantile_disc(us, 0.9) as p90, quantile_disc(us, 0.99) as p99 from r""",
)
def quick_bench(spark, d) -> DataFrame:
    out = T.quick_bench(log(spark, d))
    return out.withColumn("hit_rate", F.round("hit_rate", 9)).withColumn("origin_qps", F.round("origin_qps", 9))


@query("sketch_estimate", f"with {LOG_SQL} select key, count(*) as estimate from log group by key")
def sketch_estimate(spark, d) -> DataFrame:
    """Estimates of a sketch that is wide beside the keys, so that the least of four cells is a key's own count; keys that
    share all of their cells are counted."""
    rows = log(spark, d)
    cells = H.sketch_cells(F.col("key"), width=A.sketch_width(rows.agg(F.approx_count_distinct("key")).first()[0]))
    return A.sketch_estimates(rows, A.sketch(rows, cells), cells, rows)


@query("sketch_window", f"with {LOG_SQL}, s as (select *, at_ms // {24 * HOUR} as slice from log), m as (select max(slice) - 2 as moment from s) select k.key, count(s.seq) as estimate from (select distinct key from log) k cross join m left join s on s.key = k.key and s.slice <= moment and s.slice > moment - 6 group by k.key")
def sketch_window(spark, d) -> DataFrame:
    """The same over the last six slices before a moment: older slices have been cleared."""
    rows = log(spark, d).withColumn("slice", F.floor(F.col("at_ms") / (24 * HOUR)).cast("long"))
    at, keys = rows.agg(F.max("slice"), F.approx_count_distinct("key")).first()
    cells, moment = H.sketch_cells(F.col("key"), width=A.sketch_width(keys)), (at or 0) - 2
    live = rows.where((F.col("slice") <= moment) & (F.col("slice") > moment - 6))
    return A.sketch_estimates(rows, A.sketch_at(A.sketch(rows, cells, "slice"), moment, 6), cells, live)


@query(
    "recent_keys",
    f"""with recursive {LOG_SQL}, e as (select shard, key, row_number() over (partition by shard order by seq) as i from log), s as (
      select shard, i, [key] as held from e where i = 1
      union all
      select e.shard, e.i, case when list_contains(s.held, e.key) then s.held when len(s.held) >= 20 then list_append(s.held[2:], e.key) else list_append(s.held, e.key) end
      from s join e on e.shard = s.shard and e.i = s.i + 1
    ), last as (select shard, arg_max(held, i) as held from s group by shard), n as (select shard, held, unnest(range(len(held))) as place from last)
    select shard, cast(place as integer) as place, held[place + 1] as key from n""",
)
def recent_keys(spark, d) -> DataFrame:
    return A.recent_keys(log(spark, d), 20)


_READS = "count_if(outcome in ('hit', 'negative_hit', 'miss', 'stale'))"


@query("hit_rate", f"with {RESOLVED_SQL} select level, count_if(outcome in ('hit', 'negative_hit')) as hits, {_READS} as reads, round(case when {_READS} > 0 then count_if(outcome in ('hit', 'negative_hit')) / {_READS}::double else 0.0 end, 9) as hit_rate from resolved group by level")
def hit_rate(spark, d) -> DataFrame:
    return T.hit_rate(resolved(spark, d), "level").withColumn("hit_rate", F.round("hit_rate", 9))


@query(
    "origin_qps",
    f"""with {RESOLVED_SQL}, a as (select r.*, l.at_ms, l.shard from resolved r join log l on r.seq = l.seq)
    select shard, count_if(outcome not in ('hit', 'negative_hit')) as origin_reads, round(count_if(outcome not in ('hit', 'negative_hit')) / ((max(at_ms) - min(at_ms)) / 1000.0), 9) as origin_qps from a group by shard""",
)
def origin_qps(spark, d) -> DataFrame:
    rows = resolved(spark, d).join(log(spark, d).select("seq", "at_ms", "shard"), "seq")
    return T.origin_qps(rows, "shard").withColumn("origin_qps", F.round("origin_qps", 9))


_Q = ", ".join(f"quantile_disc(l_extendedprice, {q}) as {n}" for n, q in T.PERCENTILES.items())


@query("latency_percentiles", f"select l_returnflag, {_Q}, max(l_extendedprice) as most, round(avg(l_extendedprice), 6) as mean, count(l_extendedprice) as n from lineitem group by l_returnflag")
def latency_percentiles(spark, d) -> DataFrame:
    return T.latency_summary(load(spark, d, "lineitem"), "l_extendedprice", "l_returnflag").withColumn("mean", F.round("mean", 6))


@query("latency_sketch")
def latency_sketch(spark, d) -> DataFrame:
    """Percentiles from sketches of each line status, merged by return flag."""
    rows = load(spark, d, "lineitem").withColumn("us", F.col("l_extendedprice").cast("long"))
    return T.merged_percentiles(T.latency_sketch(rows, "us", "l_returnflag", "l_linestatus"), "l_returnflag")


@query(
    "openloop_lateness",
    f"""with {LOG_SQL}, r as (select shard, seq, at_ms * 1000 as s, at_ms * 1000 + (seq * 7919 % 5000) as e, seq // 3 as i from log),
    d as (select *, min(s) over (partition by shard) + i * 777600000 as due from r)
    select shard, seq, e - due as latency_us, s - due > 777600000 as behind from d""",
)
def openloop_lateness(spark, d) -> DataFrame:
    rows = log(spark, d).select("shard", "seq", (F.col("at_ms") * 1000).alias("started_us"), (F.col("at_ms") * 1000 + F.col("seq") * 7919 % 5000).alias("ended_us"), F.floor(F.col("seq") / 3).cast("long").alias("i"))
    return T.lateness(rows, 777_600_000, "shard").select("shard", "seq", "latency_us", "behind")


@query(
    "staleness_probe",
    f"""with {LOG_SQL}, w as (select * from log where op = 'put'), r as (select key, at_ms, at_ms << 16 as row_version from log where op = 'get' and seq % 3 <> 0)
    select w.key, w.seq, w.version, min(r.at_ms) - w.at_ms as staleness_ms from w
    left join r on r.key = w.key and r.at_ms >= w.at_ms and r.at_ms - w.at_ms <= {48 * HOUR} and r.row_version >= w.version
    group by w.key, w.seq, w.version, w.at_ms""",
)
def staleness_probe(spark, d) -> DataFrame:
    rows = log(spark, d)
    reads = rows.where("op = 'get' and seq % 3 <> 0").select("key", "at_ms", F.shiftleft("at_ms", 16).alias("row_version"))
    return T.staleness(rows.where("op = 'put'"), reads, 48 * HOUR)


@query(
    "counter_rate",
    """with s as (select event_type, epoch_us(ts) // 1000 as at_ms, event_id % 1000 as value from events),
    l as (select *, lag(value) over w as b, lag(at_ms) over w as t from s window w as (partition by event_type order by at_ms))
    select event_type, at_ms, round(case when at_ms > t then (case when value < b then value else value - b end) * 1000.0 / (at_ms - t) end, 9) as rate from l""",
)
def counter_rate(spark, d) -> DataFrame:
    from ..functions.columns import epoch_ms

    rows = load(spark, d, "events").select("event_type", epoch_ms(F.col("ts")).alias("at_ms"), (F.col("event_id") % 1000).alias("value"))
    return T.counter_rate(rows, ["event_type"]).select("event_type", "at_ms", F.round("rate", 9).alias("rate"))


@query(
    "histogram_quantile",
    """with b as (select l_returnflag as f, le, count_if(l_extendedprice <= le) as n from lineitem cross join (select unnest([1000.0, 5000.0, 20000.0, 50000.0, 100000.0, 200000.0])::double as le) group by 1, 2),
    w as (select *, coalesce(lag(le) over (partition by f order by le), 0.0) as low, coalesce(lag(n) over (partition by f order by le), 0) as below, max(n) over (partition by f) * 0.9 as rank from b)
    select f as l_returnflag, round(min(low + (le - low) * (rank - below) / (n - below)), 6) as quantile from w where n >= rank and below < rank group by f""",
)
def histogram_quantile(spark, d) -> DataFrame:
    edges = [1000.0, 5000.0, 20000.0, 50000.0, 100000.0, 200000.0]
    counts = load(spark, d, "lineitem").groupBy("l_returnflag").agg(*(F.count_if(F.col("l_extendedprice") <= e).alias(f"b{i}") for i, e in enumerate(edges)))
    buckets = counts.select("l_returnflag", F.explode(F.array(*(F.struct(F.lit(e).alias("le"), F.col(f"b{i}").alias("n")) for i, e in enumerate(edges)))).alias("b")).select("l_returnflag", "b.le", "b.n")
    return T.histogram_quantile(buckets, 0.9, ["l_returnflag"]).select("l_returnflag", F.round("quantile", 6).alias("quantile"))


# Benchmark runs: an order's line items as runs of its customer's market segment.
RUNS_SQL = "runs as (select c_mktsegment as phase, o_orderkey as run, o_totalprice as p99_us, o_totalprice / 2 as p50_us, o_orderkey % 3 as errors from orders join customer on o_custkey = c_custkey)"


def runs(spark, d) -> DataFrame:
    rows = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("c_mktsegment").alias("phase"), F.col("o_orderkey").alias("run"), F.col("o_totalprice").alias("p99_us"), (F.col("o_totalprice") / 2).alias("p50_us"), (F.col("o_orderkey") % 3).alias("errors"))


@query(
    "upper_median_runs",
    f"with {RUNS_SQL} select phase, list_sort(list(p50_us))[len(list(p50_us)) // 2 + 1] as p50_us, list_sort(list(p99_us))[len(list(p99_us)) // 2 + 1] as p99_us, min(p99_us) as p99_least, max(p99_us) as p99_most, cast(sum(errors) as bigint) as errors, count(*) as runs, count(*) >= 3 as sufficient from runs group by phase",
)
def upper_median_runs(spark, d) -> DataFrame:
    return P.run_figures(runs(spark, d), "phase")


@query(
    "merge_reports",
    f"""with {RUNS_SQL}, m as (select phase, run, case when run % 2 = 0 then p99_us end as latency, case when run % 3 = 0 then p50_us end as staleness from runs)
    select phase, arg_max(latency, case when latency is not null then run end) as latency, arg_max(staleness, case when staleness is not null then run end) as staleness from m group by phase""",
)
def merge_reports(spark, d) -> DataFrame:
    rows = runs(spark, d).select("phase", "run", F.when(F.col("run") % 2 == 0, F.col("p99_us")).alias("latency"), F.when(F.col("run") % 3 == 0, F.col("p50_us")).alias("staleness"))
    return P.merge_reports(rows, "phase", "run", ["latency", "staleness"])


@query(
    "p99_guard",
    """with b as (select o_custkey as k, max(o_totalprice) as v from orders where o_orderkey % 2 = 0 group by 1), c as (select o_custkey as k, max(o_totalprice) as v from orders where o_orderkey % 2 = 1 group by 1)
    select b.k as key, b.v as base, c.v as candidate, round((c.v - b.v) / b.v, 9) as change from b join c on b.k = c.k where b.v > 0 and (c.v - b.v) / b.v > 0.1""",
)
def p99_guard(spark, d) -> DataFrame:
    rows = load(spark, d, "orders")
    side = lambda odd: rows.where(F.col("o_orderkey") % 2 == odd).groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_totalprice").alias("p99"))
    return P.regressions(side(0), side(1), "key", "p99").withColumn("change", F.round("change", 9))


HISTORY_SQL = "history as (select l_linenumber as run, l_returnflag || l_linestatus as benchmark, avg(l_extendedprice) as ns, 3 as allocs from lineitem group by 1, 2)"


def history(spark, d) -> DataFrame:
    return load(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("run"), F.concat("l_returnflag", "l_linestatus").alias("benchmark")).agg(F.avg("l_extendedprice").alias("ns"), F.lit(3).alias("allocs"))


GEOMEAN_SQL = HISTORY_SQL + ", means as (select run, exp(avg(ln(ns))) as geomean from history where benchmark in (select benchmark from history group by 1 having count(distinct run) = (select count(distinct run) from history)) group by run)"


@query(
    "geomean_trend",
    f"""with {GEOMEAN_SQL}, c as (select *, (geomean / lag(geomean) over (order by run) - 1) * 100 as change from means)
    select run, round(geomean, 6) as geomean, round(change, 6) as change, case when change is null then 'first' when abs(change) < 2 then 'flat' when abs(change) < 10 then 'small' when abs(change) < 50 then 'large' else 'huge' end as band from c""",
)
def geomean_trend(spark, d) -> DataFrame:
    out = P.trends(P.geomeans(history(spark, d)))
    return out.select("run", F.round("geomean", 6).alias("geomean"), F.round("change", 6).alias("change"), "band")


@query(
    "sparklines",
    f"""with {HISTORY_SQL}, s as (select *, min(ns) over (partition by benchmark) as lo, max(ns) over (partition by benchmark) as hi from history)
    select benchmark, string_agg(substr('{P.GLYPHS}', cast(case when hi > lo then floor((ns - lo) / (hi - lo) * 7) else 0 end as bigint) + 1, 1), '' order by run) as spark from s group by benchmark""",
)
def sparklines(spark, d) -> DataFrame:
    return P.sparklines(history(spark, d))


@query(
    "host_effect",
    """with h as (select l_linenumber as run, l_returnflag || l_linestatus as benchmark, count(*) * (case when l_linenumber % 2 = 0 then 1.25 else 1.0 end) / count(*) as ns from lineitem group by 1, 2),
    x as (select *, (ns / lag(ns) over (partition by benchmark order by run) - 1) * 100 as delta from h)
    select run, count(*) as n, count(*) >= 3 and sign(min(delta)) = sign(max(delta)) and least(abs(min(delta)), abs(max(delta))) >= 10 and max(delta) - min(delta) <= 10 as host_effect from x where delta is not null group by run""",
)
def host_effect(spark, d) -> DataFrame:
    scale = F.when(F.col("run") % 2 == 0, 1.25).otherwise(1.0)
    return P.host_effects(history(spark, d).withColumn("ns", scale))


@query(
    "scrape_totals",
    "select cast(count_if(event_type = 'view') as double) as hits, cast(count_if(event_type = 'click') as double) as misses, cast(count_if(event_type = 'error') as double) as stale from events",
)
def scrape_totals(spark, d) -> DataFrame:
    """Counters written as metrics text (with comments and bad lines between), read back and summed."""
    counts = load(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    line = F.concat(F.lit('cache_operations_total{result="'), "event_type", F.lit('",user="'), "user_id", F.lit('"} '), "n")
    lines = counts.select(F.explode(F.array(line, F.lit("# HELP cache_operations_total operations"), F.lit("bad line {"))).alias("value"))
    result = F.col("labels")["result"]
    return text.scraped_totals(text.metrics(lines), {"hits": result == "view", "misses": result == "click", "stale": result == "error"})


@query("bench_text", "select 'BenchmarkPart' || p_size as benchmark, p_partkey as iterations, round(p_retailprice, 2) as ns, cast(p_size as double) as bytes, cast(p_size % 5 as bigint) as allocs from part")
def bench_text(spark, d) -> DataFrame:
    """Benchmark result lines written and read back."""
    p = load(spark, d, "part")
    line = F.concat(F.lit("BenchmarkPart"), "p_size", F.lit("-4  "), "p_partkey", F.lit("  "), F.round("p_retailprice", 2).cast("decimal(20,2)"), F.lit(" ns/op  "), "p_size", F.lit(" B/op  "), F.col("p_size") % 5, F.lit(" allocs/op"))
    return text.benchmarks(p.select(line.alias("value")))


#: Statements of a log ({k}: a key) with their kind, what a read asks for, and whether they begin or end a transaction.
STATEMENTS = [
    ("SELECT id, tenant_id, status, payload, version FROM entities WHERE id = {k}", "point_select", "id,tenant_id,status,payload,version"),
    ("select payload from app.entities where id = {k} limit 1", "point_select", "payload"),
    ("SELECT `payload` FROM `entities` WHERE `id` = {k};", "point_select", "payload"),
    ("SELECT status, payload FROM entities WHERE id = {k} -- AND tenant_id = 9", "point_select", "status,payload"),
    ("SELECT * FROM entities WHERE id = {k}", "passthrough"),
    ("SELECT updated_at FROM entities WHERE id = {k}", "passthrough"),
    ("SELECT payload FROM entities WHERE id > {k}", "passthrough"),
    ("SELECT payload FROM entities WHERE id IN ({k}, 2)", "passthrough"),
    ("SELECT payload FROM entities WHERE id = {k} OR id = 2", "passthrough"),
    ("SELECT COUNT(*) FROM entities WHERE id = {k}", "passthrough"),
    ("SELECT payload FROM entities WHERE id = {k} FOR UPDATE", "passthrough"),
    ("SELECT payload FROM entities WHERE id = {k}; DROP TABLE entities", "passthrough"),
    ("SELECT /*!40001 SQL_NO_CACHE */ payload FROM entities WHERE id = {k}", "passthrough"),
    ("SELECT payload FROM entities WHERE id = --{k}", "passthrough"),
    ("UPDATE entities SET status = 1, payload = ~x~ WHERE id = {k}", "point_write"),
    ("update `app`.`entities` set payload = ~a where b~ where id = {k}", "point_write"),
    ("delete from `entities` where `id` = {k};", "point_write"),
    ("UPDATE entities SET status = 1 WHERE tenant_id = {k}", "opaque_write"),
    ("TRUNCATE TABLE entities", "opaque_write"),
    ("INSERT IGNORE INTO app.entities (id) VALUES ({k})", "opaque_write"),
    ("REPLACE INTO entities (id) VALUES ({k})", "opaque_write"),
    ("UPDATE orders SET status = 1 WHERE id = {k}", "passthrough"),
    ("BEGIN", "passthrough", None, "begins"),
    ("select payload from entities where id = {k} and id = 2", "passthrough"),
    ("UPDATE entities SET status = ?, payload = ~?~ WHERE id = ?", "point_write"),
    ("COMMIT", "passthrough", None, "ends"),
    ("SELECT payload FROM entities WHERE id = 99999999999999999999{k}", "passthrough"),
    ("truncate entities", "opaque_write"),
    ("SELECT payload FROM entities WHERE id = {k} UNION SELECT payload FROM entities WHERE id = 43", "passthrough"),
    ("SELECT payload FROM entities", "passthrough"),
    ("DELETE FROM entities", "opaque_write"),
]
_KINDS = ", ".join(f"({i}, '{k}', {repr(c[0]) if c and c[0] else 'null'}, {repr(c[1]) if len(c) > 1 else 'null'})" for i, (_, k, *c) in enumerate(STATEMENTS))


@query(
    "classify_sql",
    f"""with t(n, kind, columns, tx) as (values {_KINDS}), s as (select o_orderkey as seq, o_custkey % 50 as connection, t.* from orders join t on t.n = o_orderkey % {len(STATEMENTS)}),
    x as (select *, coalesce(last_value(case tx when 'begins' then true when 'ends' then false end ignore nulls) over (partition by connection order by seq rows between unbounded preceding and 1 preceding), false) as in_tx from s)
    select seq, kind, columns, case when kind in ('point_select', 'point_write') then 'entities:' || seq end as key_text, in_tx,
      case when kind = 'opaque_write' then 'refused' when kind = 'point_select' and not in_tx then 'cache' else 'origin' end as served_by, kind = 'point_write' as invalidates from x""",
)
def classify_sql(spark, d) -> DataFrame:
    """A statement for each order, of the kinds above, with the order's number as its key, over 50 connections."""
    key = F.col("o_orderkey").cast("string")
    text = F.get(F.array(*(F.lit(t.replace("~", "'")) for t, *_ in STATEMENTS)), (F.col("o_orderkey") % len(STATEMENTS)).cast("int"))
    rows = load(spark, d, "orders").select(F.col("o_orderkey").alias("seq"), (F.col("o_custkey") % 50).alias("connection"), F.replace(text, F.lit("{k}"), key).alias("sql"), F.array(F.lit("7"), key).alias("args"))
    out = statements.in_transactions(statements.classify(rows, "entities", "id", ["id", "tenant_id", "status", "payload", "version"]))
    out = statements.routed(statements.bound_keys(out, "entities"))
    return out.select("seq", "kind", F.array_join("columns", ",").alias("columns"), "key_text", "in_tx", "served_by", "invalidates")


@query("json_version", "select event_id, try_cast(json_extract_string(props, '$.k') as decimal(20,0)) as version from events")
def json_version(spark, d) -> DataFrame:
    return load(spark, d, "events").select("event_id", text.json_version(F.col("props"), "k").alias("version"))


@query("seed_digest", "select cast(10000 as bigint) as n, cast(1 as bigint) as first_id, cast(10000 as bigint) as last_id, cast(256 as integer) as payload_bytes, true as same")
def seed_digest(spark, d) -> DataFrame:
    """The small profile twice: equal digests, the declared shape."""
    rows = generate.seed_rows(spark)
    cols = ["id", "tenant_id", "status", "payload"]
    a, b = generate.digest(rows, *cols), generate.digest(generate.seed_rows(spark), *cols)
    shape = rows.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max(F.octet_length("payload")).alias("payload_bytes"))
    return shape.crossJoin(a.select(F.col("xor").alias("x")).crossJoin(b.select("xor"))).select("n", "first_id", "last_id", "payload_bytes", (F.col("x") == F.col("xor")).alias("same"))


@query("workload_zipf")
def workload_zipf(spark, d) -> DataFrame:
    rows = generate.workload(spark, 100_000, 10_000)
    return rows.groupBy("key", "op").agg(F.count("*").alias("n"))


def _event_stream(spark, d, per_batch: int = 1000) -> DataFrame:
    """The events table as a stream. A file source reads folders, so the table is copied to one, in four files."""
    folder = scratch(spark, "events")
    events = load(spark, d, "events")
    events.repartition(4, "user_id").write.parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", per_batch).parquet(folder)


@query("stream_fold", f"with {STATE_SQL} select key, rv, fv, tv, live from state")
def stream_fold(spark, d) -> DataFrame:
    """The fold as a stream that takes what is there, in two micro-batches: the same state as the batch fold."""
    out = scratch(spark, "stream-fold")
    folds.run_once(folds.fold_stream(writes_of(log_of(_event_stream(spark, d, 2)))), out, scratch(spark, "stream-checkpoint"))
    return folds.latest(spark, out, "key string, rv long, fv long, tv long, live boolean", "key")


@query(
    "stream_dwell",
    f"""with recursive {RATIO_SQL}, r as (select key, slice, ratio, row_number() over (partition by key order by slice) as i from rated), s as (
      select key, i, slice, case when ratio < 0.6 then false else true end as admitted, case when ratio < 0.6 then slice end as since from r where i = 1
      union all
      select key, i, slice, case when turned then wanted else was end, case when turned then slice else since end from (
        select *, wanted <> was and (since is null or slice - since >= 3) as turned from (
          select r.key, r.i, r.slice, s.admitted as was, s.since, case when r.ratio >= 0.9 then true when r.ratio < 0.6 then false else s.admitted end as wanted
          from s join r on r.key = s.key and r.i = s.i + 1))
    ) select key, slice, admitted from s""",
)
def stream_dwell(spark, d) -> DataFrame:
    """Admission with a dwell time over a stream of ratios."""
    folder, out = scratch(spark, "ratios"), scratch(spark, "stream-dwell")
    ratios(spark, d).select("key", "slice", "ratio").write.parquet(folder)
    stream = spark.readStream.schema("key string, slice long, ratio double").option("maxFilesPerTrigger", 1000).parquet(folder)
    folds.run_once(stateful.with_dwell(stream, 0.9, 0.6, 3), out, scratch(spark, "stream-checkpoint"), "append")
    return spark.read.schema("key string, slice long, admitted boolean").parquet(f"{out}/*")


@query(
    "stream_tokens",
    f"""with recursive {LOG_SQL}, w as (select session, shard, version, row_number() over (partition by session order by seq) as i from log where op <> 'get'), s as (
      select session, i, [{{'s': shard, 'v': version}}] as held, false as dropped from w where i = 1
      union all
      select session, i, case when len(token) > 2 then token[2:] else token end, dropped or len(token) > 2 from (
        select w.session, w.i, s.dropped, list_append(list_filter(s.held, lambda x: x.s <> w.shard),
          {{'s': w.shard, 'v': greatest(w.version, coalesce(list_filter(s.held, lambda x: x.s = w.shard)[1].v, 0))}}) as token
        from s join w on w.session = s.session and w.i = s.i + 1)
    ), last as (select session, arg_max(held, i) as held, arg_max(dropped, i) as degraded from s group by session)
    select session, u.h.s as shard, u.h.v as watermark, degraded from (select session, degraded, unnest(held) as h from last) u""",
)
def stream_tokens(spark, d) -> DataFrame:
    """Session tokens of at most two shards, the least recently advanced dropped, over a stream."""
    out = scratch(spark, "stream-tokens")
    rows = log_of(_event_stream(spark, d)).where("op <> 'get'").select("session", "seq", "shard", "version")
    folds.run_once(stateful.token_stream(rows, 2), out, scratch(spark, "stream-checkpoint"))
    return folds.latest(spark, out, "session string, shard string, watermark long, degraded boolean", "session")
