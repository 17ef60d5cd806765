"""Readers of line formats: metrics text, benchmark output, key files, Markdown history, workload definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SAMPLE = r"^([a-zA-Z_:][a-zA-Z0-9_:]*)(\{(.*)\})?\s+(\S+)(\s+\d+)?\s*$"
BENCH = r"^(Benchmark\S+?)(-\d+)?\s+(\d+)\s+([0-9.]+) ns/op(\s+([0-9.]+) B/op)?(\s+(\d+) allocs/op)?"


def metrics(lines: DataFrame, col: str = "value") -> DataFrame:
    """name, labels (map), value of each sample line of the metrics text format; comments and bad lines are skipped."""
    line = F.col(col)
    value = F.expr(f"try_cast(regexp_extract(`{col}`, r'{SAMPLE}', 4) as double)")
    pairs = F.regexp_extract_all(F.regexp_extract(line, SAMPLE, 3), F.lit(r'([a-zA-Z_]\w*="(?:[^"\\]|\\.)*")'), F.lit(1))
    labels = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.regexp_extract(p, '="(.*)"$', 1).alias("value"))))
    rows = lines.where(line.rlike(SAMPLE) & ~line.startswith("#"))
    return rows.select(*(c for c in lines.columns if c != col), F.regexp_extract(line, SAMPLE, 1).alias("name"), labels.alias("labels"), value.alias("value")).where("value is not null")


def scraped_totals(samples: DataFrame, wanted: dict[str, Column]) -> DataFrame:
    """Each named total (a condition on name and labels) summed over the samples."""
    return samples.agg(*(F.coalesce(F.sum(F.when(c, F.col("value"))), F.lit(0.0)).alias(n) for n, c in wanted.items()))


def benchmarks(lines: DataFrame, col: str = "value") -> DataFrame:
    """benchmark, iterations, ns, bytes, allocs of `go test -bench` result lines; the processor suffix goes."""
    part = lambda i: F.regexp_extract(F.col(col), BENCH, i)
    number = lambda i, t: F.when(part(i) != "", part(i)).cast(t)
    rows = lines.where(F.col(col).rlike(BENCH))
    return rows.select(*(c for c in lines.columns if c != col), part(1).alias("benchmark"), number(3, "long").alias("iterations"), number(4, "double").alias("ns"), number(6, "double").alias("bytes"), number(8, "long").alias("allocs"))


def keys_of(lines: DataFrame, col: str = "value") -> DataFrame:
    """key: the lines of a key file without blanks and # comments."""
    return lines.select(F.trim(col).alias("key")).where("key <> '' and key not like '#%'")


def key_file(spark: SparkSession, path: str) -> DataFrame:
    """key, line (rising in the file's order): the keys of a file. Raises where there are none."""
    rows = keys_of(spark.read.text(path))
    if rows.isEmpty():
        raise ValueError(f"key file {path} has no keys")
    return rows.withColumn("line", F.monotonically_increasing_id())


def in_turn(keys: list[str], calls: DataFrame, n: str = "n") -> DataFrame:
    """calls (n: 0, 1, ...) with the key that a list of keys gives each: in order, and again from the start."""
    return calls.withColumn("key", F.get(F.array(*map(F.lit, keys)), (F.col(n) % len(keys)).cast("int")))


def scanned_keys(entries: DataFrame, prefix: str, suffix: str = "", share: float = 1.0, seed: int = 1) -> DataFrame:
    """Keys found in the cache's own key space (names: prefix, key, suffix), a hashed share of them. degraded is always true:
    a key that was evicted can't be found there, so what a scan checks isn't what was asked for."""
    name = F.col("name")
    key = F.substring(name, F.lit(len(prefix) + 1), F.length(name) - len(prefix) - len(suffix))
    rows = entries.where(name.startswith(prefix) & name.endswith(suffix) & (F.length(name) >= len(prefix) + len(suffix)))
    return rows.select(key.alias("key"), F.lit("scan").alias("source"), F.lit(True).alias("degraded")).where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def workload_definitions(lines: DataFrame, by: str = "file", col: str = "value") -> DataFrame:
    """One row per definition file (lines: file, value) of `name: value` lines, comments left out; a missing or unreadable
    field is null. ready: what a run needs is there and in range."""
    pattern = r"^([a-z_]+):\s*([^#]*?)\s*(#.*)?$"
    pairs = lines.where(F.col(col).rlike(pattern)).select(by, F.regexp_extract(col, pattern, 1).alias("name"), F.regexp_extract(col, pattern, 2).alias("v"))
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("v")))
    text, longs, doubles, seconds = ("id", "name", "distribution"), ("rows", "workers", "seed", "hot_key"), ("read_fraction", "rate", "theta"), ("warmup", "measure")
    out = pairs.groupBy(by).agg(*(value(c).alias(f"_{c}") for c in (*text, *longs, *doubles, *seconds)))
    out = out.select(by, *(F.col(f"_{c}").alias(c) for c in text), *(F.expr(f"try_cast(_{c} as bigint)").alias(c) for c in longs), *(F.expr(f"try_cast(_{c} as double)").alias(c) for c in doubles), *(F.expr(f"try_cast(regexp_extract(_{c}, '^([0-9]+)s$', 1) as bigint)").alias(f"{c}_s") for c in seconds))
    ready = F.col("distribution").isin("uniform", "zipfian", "hot") & F.col("read_fraction").between(0, 1) & (F.col("rows") > 0) & (F.col("rate") > 0) & (F.col("workers") > 0) & (F.col("measure_s") > 0)
    return out.withColumn("ready", F.coalesce(ready, F.lit(False)))


def write_reports(reports: DataFrame, path: str) -> None:
    """A report sink: one JSON document a row."""
    reports.write.mode("append").json(path)


def reports(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document per file, under an explicit schema (no inference pass)."""
    return spark.read.schema(schema).json(path, multiLine=True)


def json_version(value: Column, field: str) -> Column:
    """A top-level field of a JSON value as an unsigned 64-bit number, quoted or not; null if it isn't one. Paths into the
    document are refused: a name is one field's, whatever signs it holds."""
    text = F.get_json_object(value, f"$['{field}']")
    number = F.when(text.rlike("^[0-9]{1,20}$"), text.cast("decimal(20,0)"))
    return F.when(number <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), number)
