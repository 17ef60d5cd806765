"""Declared tables against live ones, rows against their encoding, records against catalogues."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import TableSpec, decode_row, encode_row


def catalog(spark: SparkSession, specs: list[TableSpec]) -> DataFrame:
    """A row per declared column: table_name, ordinal, column_name, type, nullable, is_key, is_version, fingerprint."""
    rows = [(t.name, i, c.name, c.type, c.nullable, c.name in t.key, c.name == t.version, t.fingerprint) for t in specs for i, c in enumerate(t.columns)]
    return spark.createDataFrame(rows, "table_name string, ordinal int, column_name string, type string, nullable boolean, is_key boolean, is_version boolean, fingerprint string")


def drift(declared: DataFrame, live: DataFrame) -> DataFrame:
    """declared and live (table_name, column_name, nullable): columns that are missing, changed or merely extra."""
    d = declared.select("table_name", "column_name", F.col("nullable").alias("d"))
    both = d.join(live.select("table_name", "column_name", F.col("nullable").alias("l")), ["table_name", "column_name"], "full")
    state = F.when(F.col("l").isNull(), "missing").when(F.col("d").isNull(), "extra").when(F.col("d") != F.col("l"), "nullability").otherwise("same")
    return both.select("table_name", "column_name", state.alias("state")).where("state <> 'same'")


def coverage(catalogue: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """The catalogue with `recorded`, and the fraction of it that is (a one-row total, so a scalar)."""
    done = records.select(key).distinct().withColumn("recorded", F.lit(True))
    rows = catalogue.join(done, key, "left").withColumn("recorded", F.coalesce("recorded", F.lit(False)))
    total = rows.agg((F.count_if("recorded") / F.count("*")).alias("fraction"))
    return rows.crossJoin(F.broadcast(total))  # one row


def phase_table(phases: DataFrame, figures: DataFrame, by: str = "phase") -> DataFrame:
    """Every phase, measured or not; what wasn't shows a dash."""
    cols = [c for c in figures.columns if c != by]
    return phases.join(figures, by, "left").select(*phases.columns, *(F.coalesce(F.col(c).cast("string"), F.lit("—")).alias(c) for c in cols))


def encoded(*cols: Column) -> Column:
    """Rows of binary values in the row format, batch by batch."""

    @F.pandas_udf("binary")
    def run(*values: pd.Series) -> pd.Series:
        return pd.Series([encode_row([None if v is None else bytes(v) for v in row]) for row in zip(*values)])

    return run(*cols)


def decoded(row: Column, columns: int) -> Column:
    """The values of an encoded row, an array of binary; null where the bytes are no such row."""

    @F.pandas_udf("array<binary>")
    def run(rows: pd.Series) -> pd.Series:
        out = []
        for r in rows:
            try:
                out.append(None if r is None else decode_row(bytes(r), columns))
            except ValueError:
                out.append(None)
        return pd.Series(out)

    return run(row)


def history_rows(lines: DataFrame, col: str = "value") -> DataFrame:
    """Rows of a Markdown table of runs: run (first cell) and cells (`ns · allocs` each), header and rule left out."""
    cells = F.transform(F.split(F.regexp_replace(F.trim(F.col(col)), r"^\||\|$", ""), r"\|"), lambda x: F.trim(x))
    rows = lines.where(F.trim(F.col(col)).startswith("|") & ~F.col(col).rlike(r"^\s*\|\s*:?-")).select(cells.alias("c"))
    figures = F.transform(F.slice("c", 2, F.greatest(F.size("c") - 1, F.lit(0))), lambda x: F.struct(F.regexp_extract(x, r"^([0-9.]+)", 1).alias("ns"), F.regexp_extract(x, r"· *([0-9]+)", 1).alias("allocs")))
    return rows.where(F.col("c")[0] != "run").select(F.col("c")[0].alias("run"), F.transform(figures, lambda x: F.struct(F.when(x["ns"] != "", x["ns"]).cast("double").alias("ns"), F.when(x["allocs"] != "", x["allocs"]).cast("long").alias("allocs"))).alias("figures"))
