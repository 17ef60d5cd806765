"""Consistent-hash placement of keys: shares and moves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import ring_node


def placed(keys: DataFrame, nodes: list[str], copies: int = 256, key: str = "key") -> DataFrame:
    return keys.withColumn("node", ring_node(F.col(key), nodes, copies))


def ring_share(keys: DataFrame, nodes: list[str], copies: int = 256, key: str = "key") -> DataFrame:
    """How many keys each node has, and their share. The counts are few rows; the total is their sum."""
    counts = placed(keys, nodes, copies, key).groupBy("node").agg(F.count("*").alias("n_keys"))
    total = counts.agg(F.sum("n_keys").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("node", "n_keys", (F.col("n_keys") / F.col("total")).alias("share"))  # one row


def ring_moves(keys: DataFrame, before: list[str], after: list[str], copies: int = 256, key: str = "key") -> DataFrame:
    """Keys that change their node, by old and new node."""
    rows = keys.select(key, ring_node(F.col(key), before, copies).alias("old"), ring_node(F.col(key), after, copies).alias("new"))
    return rows.where("old <> new").groupBy("old", "new").agg(F.count("*").alias("n_keys"))
