"""Queries: declared tables, encoded rows, coverage, tables of figures, an offline check of all levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns
from ..operators import catalog as K
from ..operators import reports, sessions, statements, telemetry
from ..sources import text
from .base import load, query
from .read_queries import CACHED_SQL, cached_reads
from .state_queries import ENTITIES, GADGETS
from .traffic_queries import RUNS_SQL, runs


def _columns_sql() -> str:
    rows = [f"('{t.name}', {i}, '{c.name}', '{c.type}', {str(c.nullable).lower()}, {str(c.name in t.key).lower()}, {str(c.name == t.version).lower()})" for t in (ENTITIES, GADGETS) for i, c in enumerate(t.columns)]
    return f"values {', '.join(rows)}"


@query("catalog", f"select * from ({_columns_sql()}) t(table_name, ordinal, column_name, type, nullable, is_key, is_version)")
def catalog(spark, d) -> DataFrame:
    return K.catalog(spark, [ENTITIES, GADGETS]).drop("fingerprint")


@query(
    "schema_drift",
    """select 'orders' as table_name, * from (values ('o_shippriority', 'missing'), ('o_custkey', 'extra'), ('o_orderdate', 'extra'), ('o_orderstatus', 'nullability')) t(column_name, state)""",
)
def schema_drift(spark, d) -> DataFrame:
    """A declaration of the orders table that misses two columns, has one too many and another nullability."""
    declared = spark.createDataFrame([("orders", c, n) for c, n in (("o_orderkey", True), ("o_orderstatus", False), ("o_totalprice", True), ("o_orderpriority", True), ("o_shippriority", True))], "table_name string, column_name string, nullable boolean")
    live = spark.createDataFrame([("orders", f.name, f.nullable) for f in load(spark, d, "orders").schema.fields], declared.schema)
    return K.drift(declared, live)


@query("row_codec", "select c_custkey, true as same, 1 + 1 + 1 + octet_length(encode(c_name)) + case when c_acctbal < 0 then 0 else 1 + octet_length(encode(c_mktsegment)) end as size from customer")
def row_codec(spark, d) -> DataFrame:
    """Rows encoded and decoded again; the segment is null for negative balances."""
    segment = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment").cast("binary"))
    rows = load(spark, d, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("n"), segment.alias("s"))
    rows = rows.withColumn("e", K.encoded(F.col("n"), F.col("s"))).withColumn("v", K.decoded(F.col("e"), 2))
    return rows.select("c_custkey", (F.col("v")[0].eqNullSafe(F.col("n")) & F.col("v")[1].eqNullSafe(F.col("s"))).alias("same"), F.octet_length("e").alias("size"))


@query(
    "coverage",
    """with c as (select n_nationkey as number, n_name as title from nation), r as (select distinct s_nationkey as number from supplier),
    x as (select c.*, r.number is not null as recorded from c left join r on c.number = r.number)
    select number, title, recorded, round(count_if(recorded) over () / (count(*) over ())::double, 9) as fraction from x""",
)
def coverage(spark, d) -> DataFrame:
    c = load(spark, d, "nation").select(F.col("n_nationkey").alias("number"), F.col("n_name").alias("title"))
    out = K.coverage(c, load(spark, d, "supplier").select(F.col("s_nationkey").alias("number")), "number")
    return out.withColumn("fraction", F.round("fraction", 9))


@query(
    "phase_table",
    f"""with {RUNS_SQL}, f as (select phase, count(*) as runs, cast(sum(errors) as bigint) as errors from runs where phase <> 'BUILDING' group by phase),
    p as (select distinct c_mktsegment as phase from customer)
    select p.phase, coalesce(cast(runs as varchar), '—') as runs, coalesce(cast(errors as varchar), '—') as errors from p left join f on p.phase = f.phase""",
)
def phase_table(spark, d) -> DataFrame:
    phases = load(spark, d, "customer").select(F.col("c_mktsegment").alias("phase")).distinct()
    figures = runs(spark, d).where("phase <> 'BUILDING'").groupBy("phase").agg(F.count("*").alias("runs"), F.sum("errors").alias("errors"))
    return K.phase_table(phases, figures)


@query("history_rows", "select cast(p_partkey as varchar) as run, cast(p_size as double) as ns, cast(p_size % 4 as bigint) as allocs from part")
def history_rows(spark, d) -> DataFrame:
    p = load(spark, d, "part")
    row = F.concat(F.lit("| "), "p_partkey", F.lit(" | "), "p_size", F.lit(" · "), F.col("p_size") % 4, F.lit(" | — |"))
    lines = p.select(F.explode(F.array(row, F.lit("| run | BenchmarkA | BenchmarkB |"), F.lit("|---|---|---|"), F.lit("text"))).alias("value"))
    out = K.history_rows(lines)
    return out.select("run", F.col("figures")[0]["ns"].alias("ns"), F.col("figures")[0]["allocs"].alias("allocs"))


@query(
    "offline_check",
    f"""with {CACHED_SQL}, r as (select *, max(fv) over (partition by session, key order by seq rows between unbounded preceding and 1 preceding) as seen from cached where op = 'get' and fv is not null)
    select shard, count(*) as probes, count_if(watermark is not null and fv < watermark) as session_breaks,
      count_if((fv >> 16) < at_ms - {24 * 3_600_000}) as bounded_breaks, count_if(fv < seen) as monotonic_breaks from r group by shard""",
)
def offline_check(spark, d) -> DataFrame:
    """What a probe log says about each level: reads below the session's watermark, beyond the bound, going back."""
    rows = cached_reads(spark, d)
    back = sessions.non_monotonic_reads(rows, "fv").select("seq").withColumn("back", F.lit(True))
    low = F.coalesce(F.col("fv") < F.col("watermark"), F.lit(False))
    old = F.shiftrightunsigned("fv", 16) < F.col("at_ms") - 24 * 3_600_000
    return rows.join(back, "seq", "left").groupBy("shard").agg(F.count("*").alias("probes"), F.count_if(low).alias("session_breaks"), F.count_if(old).alias("bounded_breaks"), F.count_if(F.coalesce("back", F.lit(False))).alias("monotonic_breaks"))


@query("count_above", "select l_returnflag, count_if(floor(l_extendedprice / 1000) * 1000 > 50000) as above, count(*) as n, round(count_if(floor(l_extendedprice / 1000) * 1000 > 50000) / count(*)::double, 9) as share from lineitem group by l_returnflag")
def count_above(spark, d) -> DataFrame:
    """How many prices lie in buckets of 1000 that begin above 50000."""
    low = F.floor(F.col("l_extendedprice") / 1000).cast("double") * 1000
    buckets = load(spark, d, "lineitem").groupBy("l_returnflag", low.alias("low")).agg(F.count("*").alias("n"))
    return telemetry.count_above(buckets, 50_000, "l_returnflag").withColumn("share", F.round("share", 9))


@query("success_ratio", "select user_id % 5 as part, cast(count_if(event_type <> 'error') as double) as good, cast(count(*) as double) as whole, round(count_if(event_type <> 'error') / count(*)::double, 9) as ratio from events group by 1")
def success_ratio(spark, d) -> DataFrame:
    samples = load(spark, d, "events").groupBy((F.col("user_id") % 5).alias("part"), "event_type").agg(F.count("*").cast("double").alias("increase"))
    return telemetry.success_ratio(samples, F.col("event_type") != "error", "part").withColumn("ratio", F.round("ratio", 9))


@query(
    "newest_commits",
    """with h as (select 'c' || o_custkey as c, o_orderkey as moment, o_orderpriority as b, floor(o_totalprice) as ns, o_orderkey % 5 as allocs from orders),
    l as (select c, max(moment) as last from h group by c order by last desc, c desc limit 25)
    select moment as "at", '| ' || h.c || ' | ' || coalesce(max(case when b = '1-URGENT' then printf('%.1f', ns) || ' · ' || allocs end), '—') || ' | ' || coalesce(max(case when b = '5-LOW' then printf('%.1f', ns) || ' · ' || allocs end), '—') || ' |' as line
    from h join l on h.c = l.c and h.moment = l.last group by h.c, moment""",
)
def newest_commits(spark, d) -> DataFrame:
    """The history of the 25 newest commits as rows of a table of two benchmarks."""
    h = load(spark, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("commit"), F.col("o_orderkey").alias("at"), F.col("o_orderpriority").alias("benchmark"), F.floor("o_totalprice").cast("double").alias("ns"), (F.col("o_orderkey") % 5).alias("allocs"))
    return reports.history_table(reports.newest(h, 25), ["1-URGENT", "5-LOW"])


@query("typed_results", "select p_partkey, case when p_partkey % 4 <> 0 and p_partkey <= 255 then p_partkey::decimal(20,0) end as number, p_partkey % 4 <> 0 and p_partkey <= 255 as served, octet_length(encode(p_name)) as bytes from part")
def typed_results(spark, d) -> DataFrame:
    """Cached texts as results: a small integer (with leading zeros, or too large, it isn't served) and bytes."""
    text = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("0"), "p_partkey")).otherwise(F.col("p_partkey").cast("string"))
    rows = load(spark, d, "part").select("p_partkey", statements.typed(text, "uint8").alias("i"), statements.typed(F.col("p_name"), "bytes").alias("b"))
    return rows.select("p_partkey", F.col("i.number").alias("number"), F.col("i.served").alias("served"), F.octet_length("b.bytes").alias("bytes"))


@query("scanned_keys", "select 'entities:' || c_custkey as key, 'scan' as source, true as degraded from customer")
def scanned_keys(spark, d) -> DataFrame:
    """Keys found in a key space that holds other names too."""
    c = load(spark, d, "customer")
    names = c.select(F.concat(F.lit("app:{entities:"), "c_custkey", F.lit("}")).alias("name")).unionByName(c.select(F.concat(F.lit("lock:"), "c_custkey").alias("name")))
    return text.scanned_keys(names, "app:{", "}")


@query("keys_in_turn", "select n_nationkey as n, ['a', 'b', 'c'][n_nationkey % 3 + 1] as key from nation")
def keys_in_turn(spark, d) -> DataFrame:
    return text.in_turn(["a", "b", "c"], load(spark, d, "nation").select(F.col("n_nationkey").alias("n")))


@query("quoted_names", "select c_custkey, '`' || replace(c_name || '`x', '`', '``') || '`' as quoted, 'row:' || c_custkey || ':v' as filled from customer")
def quoted_names(spark, d) -> DataFrame:
    c = load(spark, d, "customer")
    return c.select("c_custkey", columns.quote_identifier(F.concat("c_name", F.lit("`x"))).alias("quoted"), columns.fill_template(F.lit("row:{key}:v"), F.col("c_custkey").cast("string")).alias("filled"))
