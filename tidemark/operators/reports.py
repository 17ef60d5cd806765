"""Analytics over benchmark reports: runs into figures, figures against each other, history into trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import at_ranks

#: A figure needs this many runs.
ENOUGH_RUNS = 3
GLYPHS = "▁▂▃▄▅▆▇█"


def run_figures(runs: DataFrame, *by: str) -> DataFrame:
    """runs (p50_us, p99_us, errors): upper medians (element n / 2, counted from 0, of the sorted values), the spread of
    p99, all errors, whether there are enough runs. Medians come from ranks of counted values, not from lists."""
    n = F.count("*")
    out = runs.groupBy(*by).agg(F.min("p99_us").alias("p99_least"), F.max("p99_us").alias("p99_most"), F.sum("errors").alias("errors"), n.alias("runs"), (n >= ENOUGH_RUNS).alias("sufficient"))
    for c in ("p50_us", "p99_us"):
        out = out.join(at_ranks(runs, c, list(by), {c: F.floor(F.col("n") / 2) + 1}), list(by), "left")
    return out.select(*by, "p50_us", "p99_us", "p99_least", "p99_most", "errors", "runs", "sufficient")


def newest(history: DataFrame, most: int, commit: str = "commit", at: str = "at") -> DataFrame:
    """The rows of the `most` newest commits; a commit that was measured again counts with its newest rows alone."""
    last = history.groupBy(commit).agg(F.max(at).alias("last"))
    kept = last.orderBy(F.desc("last"), F.desc(commit)).limit(most)  # the feature: a history of that length
    return history.join(kept, commit).where(F.col(at) == F.col("last")).drop("last")


def history_table(history: DataFrame, benchmarks: list[str], commit: str = "commit", at: str = "at") -> DataFrame:
    """at, line: a Markdown row for each commit, with `ns · allocs` of each benchmark, a dash where it has none."""
    cell = F.concat(F.format_string("%.1f", "ns"), F.lit(" · "), F.col("allocs"))
    wide = history.groupBy(commit, at).agg(*(F.coalesce(F.max(F.when(F.col("benchmark") == b, cell)), F.lit("—")).alias(f"b{i}") for i, b in enumerate(benchmarks)))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col(commit), *(F.col(f"b{i}") for i in range(len(benchmarks)))), F.lit(" |"))
    return wide.select(at, line.alias("line"))


def merge_reports(reports: DataFrame, by: str, at: str, fields: list[str]) -> DataFrame:
    """The newest measured value of each field: reports that measured something else don't erase it."""
    newest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col(at))).alias(f) for f in fields]
    return reports.groupBy(by).agg(*newest)


def regressions(base: DataFrame, candidate: DataFrame, by: str, field: str, threshold: float = 0.1) -> DataFrame:
    """Where the candidate's figure is worse than the base's by more than the threshold."""
    rows = base.select(by, F.col(field).alias("base")).join(candidate.select(by, F.col(field).alias("candidate")), by)
    change = (F.col("candidate") - F.col("base")) / F.col("base")
    return rows.withColumn("change", change).where((F.col("base") > 0) & (F.col("change") > threshold))


def geomeans(history: DataFrame, by: str = "run", value: str = "ns") -> DataFrame:
    """Geometric mean of each run over the benchmarks that all runs share."""
    runs = history.select(F.count_distinct(by).alias("all"))
    shared = history.groupBy("benchmark").agg(F.count_distinct(by).alias("n")).crossJoin(F.broadcast(runs)).where("n = all").select("benchmark")  # one row
    return history.join(shared, "benchmark", "left_semi").where(F.col(value) > 0).groupBy(by).agg(F.exp(F.avg(F.log(value))).alias("geomean"))


def trends(means: DataFrame, by: str = "run") -> DataFrame:
    """Change against the run before, and its band."""
    order = Window.orderBy(by)  # one row per run
    change = (F.col("geomean") / F.lag("geomean").over(order) - 1) * 100
    size = F.abs(F.col("change"))
    band = F.when(F.col("change").isNull(), "first").when(size < 2, "flat").when(size < 10, "small").when(size < 50, "large").otherwise("huge")
    return means.withColumn("change", change).withColumn("band", band)


def sparklines(history: DataFrame, by: str = "benchmark", order: str = "run", value: str = "ns") -> DataFrame:
    """A glyph per run for each benchmark, lowest to highest; a flat history is all lowest."""
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    rows = history.groupBy(by).agg(items.alias("items"), F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = lambda x: F.when(F.col("hi") > F.col("lo"), F.floor((x["v"] - F.col("lo")) / (F.col("hi") - F.col("lo")) * 7)).otherwise(F.lit(0))
    return rows.select(by, F.array_join(F.transform("items", lambda x: F.substring(F.lit(GLYPHS), (at(x) + 1).cast("int"), F.lit(1))), "").alias("spark"))


def host_effects(history: DataFrame, by: str = "run", value: str = "ns") -> DataFrame:
    """Runs in which at least three benchmarks moved the same way by 10 % or more, at most 10 points apart, while no
    benchmark's allocations ever changed: the host, not the code."""
    order = Window.partitionBy("benchmark").orderBy(by)
    delta = (F.col(value) / F.lag(value).over(order) - 1) * 100
    flat = history.groupBy("benchmark").agg((F.count_distinct("allocs") == 1).alias("flat")).agg(F.coalesce(F.bool_and("flat"), F.lit(False)).alias("flat"))
    per = history.withColumn("delta", delta).where("delta is not null").groupBy(by).agg(F.count("*").alias("n"), F.min("delta").alias("least"), F.max("delta").alias("most"))
    alike = (F.signum("least") == F.signum("most")) & (F.least(F.abs("least"), F.abs("most")) >= 10) & (F.col("most") - F.col("least") <= 10)
    return per.crossJoin(F.broadcast(flat)).select(by, "n", (F.col("flat") & (F.col("n") >= 3) & alike).alias("host_effect"))  # one row
