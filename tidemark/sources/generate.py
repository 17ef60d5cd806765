"""Generated inputs: seeded rows, key distributions, request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILES = {"small": (10_000, 16), "medium": (1_000_000, 64), "large": (10_000_000, 256)}


def unit(*cols: Column) -> Column:
    """A number in [0, 1) from a hash: the same for the same input, on any cluster."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def seed_rows(spark: SparkSession, profile: str = "small", seed: int = 20260905, payload_bytes: int = 256) -> DataFrame:
    """id 1..N, tenant_id, status 0-3, payload: a pure function of profile and seed."""
    n, tenants = PROFILES[profile]
    rows = spark.range(1, n + 1)
    word = lambda i: F.unhex(F.sha2(F.concat_ws(":", F.lit(seed), F.col("id"), F.lit(i)), 256))
    payload = F.substring(F.concat(*(word(i) for i in range(-(-payload_bytes // 32)))), 1, payload_bytes)
    return rows.select("id", F.floor(unit(F.lit(seed), F.col("id"), F.lit(1)) * tenants).cast("long").alias("tenant_id"), F.floor(unit(F.lit(seed), F.col("id"), F.lit(2)) * 4).cast("short").alias("status"), payload.alias("payload"))


def digest(rows: DataFrame, *cols: str) -> DataFrame:
    """One row: how many, and a checksum that doesn't depend on order. Sums of hashes combine before any shuffle."""
    h = F.xxhash64(*cols)
    return rows.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).alias("total"))


def zipf_constants(n: int, theta: float) -> tuple[float, float, float]:
    """zeta(n), alpha and eta of the usual rejection-free Zipf draw. The zeta sum runs to 10,000 terms, then its integral."""
    head = min(n, 10_000)
    zeta = sum(1 / i**theta for i in range(1, head + 1))
    if n > head:
        zeta += ((n + 0.5) ** (1 - theta) - (head + 0.5) ** (1 - theta)) / (1 - theta)
    zeta2 = 1 + 0.5**theta
    return zeta, 1 / (1 - theta), (1 - (2 / n) ** (1 - theta)) / (1 - zeta2 / zeta)


def zipf_rank(u: Column, n: int, theta: float = 0.99) -> Column:
    """A rank 0..n-1, rank 0 the most frequent, from a uniform number."""
    zeta, alpha, eta = zipf_constants(n, theta)
    scaled = u * zeta
    tail = F.floor(F.lit(float(n)) * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.when(scaled < 1, F.lit(0)).when(scaled < 1 + 0.5**theta, F.lit(1)).otherwise(F.least(tail, F.lit(n - 1))).cast("long")


def workload(spark: SparkSession, requests: int, keys: int, distribution: str = "zipfian", theta: float = 0.99, read_fraction: float = 0.95, rate: float = 2000.0, seed: int = 42) -> DataFrame:
    """A request log: seq, at_ms (due time), key, op."""
    rows = spark.range(requests).withColumnRenamed("id", "seq")
    u = unit(F.lit(seed), F.col("seq"), F.lit(1))
    rank = {"zipfian": zipf_rank(u, keys, theta), "uniform": F.floor(u * keys).cast("long"), "hot": F.lit(0).cast("long")}[distribution]
    op = F.when(unit(F.lit(seed), F.col("seq"), F.lit(2)) < read_fraction, "get").otherwise("put")
    return rows.select("seq", F.floor(F.col("seq") * 1000.0 / rate).cast("long").alias("at_ms"), F.concat(F.lit("entities:"), rank + 1).alias("key"), op.alias("op"))
