"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are scaled to length one; equal vectors are one point of a graph, which keeps the few smallest ids that a
result can need (a window with a rank limit, cut down before the shuffle). Points lie in cells around centroids that are
fitted on a bounded sample (at most `sample` points, chosen by hash; every point is indexed); a cell of more than
shard_rows points is dealt by hash to several shards, so no shard is larger for a crowded cell. A task builds a shard's
graph (flat arrays of neighbours, -1 where there is none) and writes it as a row of a table in the shared folder.

A query goes to its `probes` nearest cells. How many that are is measured when the index is built: for sample points the
exact neighbours within the sample are found, and probes is the number of cells that covers a share `cover` of them. On
data without clusters that is nearly all cells, on clustered data a few. Queries are dealt in blocks; each block meets
each shard of its cells once, every shard returns its best k by exact cosine, and a rank over shards merges them. All
cosines are in double precision, so that close vectors are told apart.

Defined cases: vectors that are null, empty, of zero length or hold null or non-finite components take no part, nor
do rows without id, nor vectors whose number of components is not the commonest (the smaller at a tie); rows that
repeat an id are one; fewer candidates than k give what there is; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, partitions_for, settings, ship, stored

GRAPH = "shard int, dim int, vectors binary, ids array<array<long>>, links binary, upper array<binary>, members array<binary>, entry int"


class Graph:
    """A small-world graph over unit vectors. links[0] is (n, 2 m); upper layers hold m links of their members."""

    def __init__(self, vectors: np.ndarray, m: int = 16, breadth: int = 48, seed: int = 1):
        self.x = np.ascontiguousarray(vectors, np.float64)
        self.m, self.breadth = m, breadth
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(np.int64), 8)
        if n:
            self.level[0] = self.level.max()
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.entry = 0
        self.seen, self.mark = np.zeros(n, np.int32), 0
        for layer in range(len(self.links)):
            self._fill(layer)

    def _fill(self, layer: int) -> None:
        """Inserts a layer's members in batches, each as large as what is there, so that early points have far links."""
        who = np.flatnonzero(self.level >= layer)
        at = 1
        while at < len(who):
            new = who[at : at + min(at, 256)]
            self._insert(layer, who[: at + len(new)], new)
            at += len(new)

    def _insert(self, layer: int, there: np.ndarray, new: np.ndarray) -> None:
        """Links the points `new` (the last of `there`) to their nearest of `there`, and those back to them."""
        sims = self.x[new] @ self.x[there].T
        own = np.arange(len(there) - len(new), len(there))
        sims[np.arange(len(new)), own] = -np.inf
        k = min(self.breadth, len(there) - 1)
        near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        order = np.argsort(-np.take_along_axis(sims, near, 1), axis=1, kind="stable")
        near = there[np.take_along_axis(near, order, 1)]
        chosen = self._choose(new, near, self.m)
        links = self.links[layer]
        links[new, : chosen.shape[1]] = chosen
        # Back links: each target's own list with the new ones behind it.
        source, target = np.repeat(new, chosen.shape[1]), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        whom, first, n = np.unique(target, return_index=True, return_counts=True)
        most = links.shape[1]
        wide = np.full((len(whom), most + int(n.max())), -1, np.int32)
        wide[:, :most] = links[whom]
        wide[np.repeat(np.arange(len(whom)), n), most + np.arange(len(target)) - np.repeat(first, n)] = source
        size = (wide >= 0).sum(axis=1)
        wide = np.take_along_axis(wide, np.argsort(wide < 0, axis=1, kind="stable"), 1)
        links[whom[size <= most]] = wide[size <= most, :most]
        for at in range(0, int((size > most).sum()), 256):
            over = np.flatnonzero(size > most)[at : at + 256]
            rows = self._sorted(whom[over], wide[over])
            links[whom[over]] = -1
            kept = self._choose(whom[over], rows, most)
            links[whom[over], : kept.shape[1]] = kept

    def _sorted(self, points: np.ndarray, near: np.ndarray) -> np.ndarray:
        sims = np.where(near >= 0, np.einsum("bkd,bd->bk", self.x[near], self.x[points]), -np.inf)
        return np.take_along_axis(near, np.argsort(-sims, axis=1, kind="stable"), 1)

    def _choose(self, points: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of the candidates (best first, -1 where there is none) those that are nearer to the point than to one already
        chosen, then the nearest of the others; -1 fills up."""
        there = near >= 0
        vectors = self.x[near]
        sims = np.einsum("bkd,bd->bk", vectors, self.x[points])
        among = vectors @ vectors.transpose(0, 2, 1)
        closest = np.full(near.shape, -np.inf)
        picked = np.zeros(near.shape, bool)
        for k in range(near.shape[1]):
            take = there[:, k] & (closest[:, k] < sims[:, k]) & (picked.sum(axis=1) < most)
            picked[:, k] = take
            closest[take] = np.maximum(closest[take], among[take, k])
        order = np.argsort(np.where(picked, 0, np.where(there, 1, 2)), axis=1, kind="stable")[:, :most]
        return np.where(np.take_along_axis(there, order, 1), np.take_along_axis(near, order, 1), -1)

    def _search(self, q: np.ndarray, start: np.ndarray, layer: int, breadth: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest points found on a layer, best first, with their cosines. Expands several points at a time."""
        self.mark += 1
        seen, links, x = self.seen, self.links[layer], self.x
        seen[start] = self.mark
        ids, sims = start, x[start] @ q
        done = np.zeros(len(ids), bool)
        while True:
            open_ = np.flatnonzero(~done)[: 4 if breadth > 1 else 1]
            if not len(open_):
                return ids, sims
            done[open_] = True
            near = links[ids[open_]].ravel()
            near = near[near >= 0]
            near = near[seen[near] != self.mark]
            if not len(near):
                continue
            if len(open_) > 1:
                near = np.unique(near)
            seen[near] = self.mark
            found = x[near] @ q
            if len(ids) >= breadth:
                good = found > sims[-1]
                near, found = near[good], found[good]
                if not len(near):
                    continue
            ids, sims = np.concatenate([ids, near]), np.concatenate([sims, found])
            done = np.concatenate([done, np.zeros(len(near), bool)])
            order = np.argsort(-sims, kind="stable")[:breadth]
            ids, sims, done = ids[order], sims[order], done[order]

    def find(self, q: np.ndarray, k: int, breadth: int) -> np.ndarray:
        if not len(self.x):
            return np.zeros(0, np.int64)
        at = np.array([self.entry])
        for layer in range(len(self.links) - 1, 0, -1):
            at = self._search(q, at, layer, 1)[0][:1]
        return self._search(q, at, 0, max(k, breadth))[0][:k]

    def flat(self) -> tuple[bytes, list[bytes], list[bytes]]:
        """Links of the base layer; links and members of each upper layer."""
        members = [np.flatnonzero(self.level >= k).astype(np.int32) for k in range(1, len(self.links))]
        return self.links[0].tobytes(), [x[m].tobytes() for x, m in zip(self.links[1:], members)], [m.tobytes() for m in members]

    @classmethod
    def load(cls, vectors: np.ndarray, links: bytes, upper: list[bytes], members: list[bytes], entry: int, m: int) -> "Graph":
        self = cls.__new__(cls)
        n = len(vectors)
        self.x, self.m, self.entry, self.seen, self.mark = np.ascontiguousarray(vectors, np.float64), m, entry, np.zeros(n, np.int32), 0
        self.links = [np.frombuffer(links, np.int32).reshape(n, 2 * m)]
        for data, who in zip(upper, members):
            layer = np.full((n, m), -1, np.int32)
            layer[np.frombuffer(who, np.int32)] = np.frombuffer(data, np.int32).reshape(-1, m)
            self.links.append(layer)
        return self


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v (array of doubles) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    rows = rows.where(F.size("v") == (common["dim"] if common else 0))
    return rows.dropDuplicates(["vec_id"])


@dataclass
class Index:
    """graphs: columns of GRAPH, in the shared folder. shards: which shards a cell has."""

    graphs: DataFrame
    centroids: np.ndarray
    probes: int
    shards: list[range]
    m: int


def fit_cells(x: np.ndarray, cells: int, cover: float, k: int, rounds: int = 8) -> tuple[np.ndarray, int]:
    """Centroids of unit vectors (Lloyd's rounds from a spread start), and how many of the nearest cells cover a share
    `cover` of the k nearest neighbours within x."""
    if cells <= 1 or len(x) <= cells:
        return x[:1], 1
    rng = np.random.default_rng(2)
    centroids = x[rng.choice(len(x), cells, replace=False)]
    for _ in range(rounds):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(length > 0, sums / np.maximum(length, 1e-300), centroids)
    own = (x @ centroids.T).argmax(axis=1)
    asked = rng.choice(len(x), min(len(x), 500), replace=False)
    sims = x[asked] @ x.T
    sims[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-sims, min(k, len(x) - 1) - 1, axis=1)[:, :k]
    rank = np.argsort(np.argsort(-(x[asked] @ centroids.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(rank, own[near], 1).ravel())
    return centroids, int(needed[int(np.ceil(cover * len(needed))) - 1]) + 1


def build(points: DataFrame, *, shard_rows: int = 16_384, m: int = 16, breadth: int = 48, keep: int = 6, sample: int = 20_000, cover: float = 0.98) -> Index | None:
    """An index over usable()'s rows; None where there are none."""
    spark = points.sparkSession
    ship(spark)
    rank = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    few = points.withColumn("r", rank).where(F.col("r") <= keep)
    distinct = stored(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "points")
    n = distinct.count()
    if not n:
        return None
    by_hash = F.xxhash64(F.col("ids")[0], F.lit(3))
    # The sample: points whose hash is among the lowest share that gives `sample` of them, cut there.
    share = distinct if n <= sample else distinct.where(F.pmod(by_hash, F.lit(1 << 30)) < int((1 << 30) * 1.1 * sample / n)).orderBy(by_hash, F.col("ids")[0]).limit(sample)
    picked = _matrix(share.select("v").toArrow()) if n > shard_rows else np.zeros((1, 1))
    picked = _unit(picked) if n > shard_rows else picked
    centroids, probes = fit_cells(picked[np.lexsort(picked.T[:2])], min(-(-n // shard_rows), max(1, len(picked) // 16)), cover, keep - 1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch.select(["v"])))
                cell = (x @ centroids.T).argmax(axis=1) if len(centroids) > 1 else np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "v", "ids"])

    placed = stored(distinct.select("v", "ids").mapInArrow(assign, "cell int, v array<double>, ids array<long>"), "cells")
    sizes = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().collect()}  # one row a cell, at most sample / 16
    shards, first = [], 0
    for cell in range(len(centroids)):
        parts = -(-sizes.get(cell, 0) // shard_rows)
        shards.append(range(first, first + parts))
        first += parts
    firsts, parts = (F.array(*(F.lit(f(s)) for s in shards)) for f in (lambda s: s.start, len))
    shard = (F.get(firsts, F.col("cell")) + F.pmod(by_hash, F.get(parts, F.col("cell")))).cast("int")
    dealt = placed.select(shard.alias("shard"), "v", "ids", F.col("ids")[0].alias("first"))
    schema = pa.schema([("shard", pa.int32()), ("dim", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))), ("links", pa.binary()), ("upper", pa.list_(pa.binary())), ("members", pa.list_(pa.binary())), ("entry", pa.int32())])

    def graph(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("first", "ascending")])
        x = _matrix(group)
        g = Graph(_unit(x), m, breadth)
        links, upper, members = g.flat()
        row = [group.column("shard")[0].as_py(), x.shape[1], x.astype("<f8").tobytes(), group.column("ids").to_pylist(), links, upper, members, g.entry]
        return pa.table([pa.array([c], t) for c, t in zip(row, schema.types)], schema=schema)

    # One task a shard: building is what costs, so adaptive execution must not put several into one.
    with settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        graphs = stored(dealt.repartition(max(1, min(first, partitions_for(spark, 8))), "shard").groupBy("shard").applyInArrow(graph, GRAPH), "graphs")
    discard(distinct, placed)
    return Index(graphs, centroids, probes, shards, m)


def _matrix(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    v = table.column("v")
    v = v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of q with each row of x in double precision."""
    return _unit(x) @ _unit(q[None, :])[0]


def search(index: Index | None, queries: DataFrame, k: int = 5, *, breadth: int = 120, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query (query_id, v), a query's own id left out."""
    spark = queries.sparkSession
    ship(spark)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graphs, centroids, probes, shards, m = index.graphs, index.centroids, index.probes, index.shards, index.m
    routed = pa.schema([("shard", pa.int32()), ("query_id", pa.int64()), ("v", pa.list_(pa.float64()))])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _unit(_matrix(batch))
                sims = x @ centroids.T if len(centroids) > 1 else np.zeros((len(x), 1))
                cells = np.argsort(-sims, axis=1, kind="stable")[:, :probes]
                pairs = [(i, s) for i, row in enumerate(cells.tolist()) for c in row for s in shards[c]]
                at = pa.array([i for i, _ in pairs], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([s for _, s in pairs], pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], schema=routed)

    asked = queries.select("query_id", "v").mapInArrow(route, "shard int, query_id long, v array<double>")
    # At most `block` queries meet a shard at once.
    n = max(1, -(-queries.count() // block))
    asked = asked.groupBy("shard", F.pmod(F.xxhash64("query_id"), F.lit(n)).alias("block")).agg(F.collect_list("query_id").alias("qs"), F.flatten(F.collect_list("v")).alias("vs"))
    tasks = max(1, min(sum(map(len, shards)), partitions_for(spark, 4)))
    cells = asked.repartition(tasks, "shard").join(graphs.repartition(tasks, "shard").hint("shuffle_hash"), "shard")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = np.frombuffer(row["vectors"], "<f8").reshape(-1, row["dim"])
                g = Graph.load(_unit(x), row["links"], row["upper"], row["members"], row["entry"], m)
                vs = np.array(row["vs"]).reshape(len(row["qs"]), -1)
                out = []
                for query, v, unit in zip(row["qs"], vs, _unit(vs)):
                    near = g.find(unit, 8 * k + 8, breadth)
                    scores = cosine(v, x[near])
                    best = [(-s, i) for s, p in zip(scores.tolist(), near) for i in row["ids"][p] if i != query]
                    out += [(query, i, -s) for s, i in sorted(best)[:k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)] if out else [pa.array([], t) for t in schema.types], schema=schema)

    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "4", "spark.sql.parquet.columnarReaderBatchSize": "4"}):  # a row holds a graph
        found = stored(cells.select("shard", "qs", "vs", "dim", "vectors", "ids", "links", "upper", "members", "entry").mapInArrow(run, "query_id long, vec_id long, score double"), "found")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, **how) -> DataFrame:
    """search() of the rows that is_query (a condition on vec_id) picks, in an index over all rows."""
    points = stored(usable(vectors, id_col, vec_col), "vectors")
    index = build(points, keep=k + 1, **how)
    return search(index, points.where(is_query).select(F.col("vec_id").alias("query_id"), "v"), k)
