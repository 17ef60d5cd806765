"""SimHash near-duplicates by bit-sliced comparison.

`fingerprints` sums the bits of a document's shingle hashes. `links` brings fingerprints together that agree on a set
of their bits (a table), splits crowded sets into cells, compares inside cells by bit planes (bitslice.py) and returns
a minimum spanning forest of each cell: at most one link per fingerprint and table, yet no two linked fingerprints fall
apart. `groups` closes the links to components.

With 64 bits in six blocks and a table for each two blocks, two fingerprints that differ in at most four bits agree on
a table, so no link within radius 4 is missed. With more rows the tables take more, smaller blocks (b of them, a table
for each b - 4), so that keys grow with the number of rows and the fingerprints of a key don't; that stays exact. For
similarities the fingerprint is wider: see `near_duplicates`.

Defined cases: null and empty texts have no words and fingerprint zero, which links like any other; shorter texts are
one shingle; a null id never is a component's id, unless the component has none; repeated rows have one fingerprint and
so one component; an empty table gives no rows; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitslice import close_in_runs, close_to, distances, shortest_forest
from .common import discard, partitions_for, ship, stored
from .components import components

SEED = 42
#: Rows of a cell; a crowded key is split into pairs of groups of about this many.
CELL = 8192
#: Documents of at most this many shingles have candidates by shared shingles too.
SHORT = 38


def shingle_hashes(text: str | None, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles of a text whose A-Z are lower-cased."""
    from xxhash import xxh64_intdigest as h

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - k + 1)
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    stops = ends[min(k, len(words)) - 1 :].tolist()
    return np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, n)


def mixed(h: np.ndarray, word: int) -> np.ndarray:
    """Further 64 bits of a hash: the finaliser of splitmix64; word 0 is the hash itself."""
    if not word:
        return h
    z = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int = 1) -> bytes:
    """Bit b is 1 if it is set in over half the hashes."""
    out = b""
    for w in range(words):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 20_000):
            part = mixed(h[at : at + 20_000], w).astype(">u8").view(np.uint8).reshape(-1, 8)
            count += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
        out += np.packbits(count * 2 > len(h)).tobytes()
    return out


def prefix(h: np.ndarray, similarity: float) -> list[int]:
    """The least shingle hashes (of a sorted set) of which two sets share one at least, if they are that similar."""
    return h[: len(h) - int(np.ceil(similarity * len(h) - 1e-9)) + 1].view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, words: int = 1, repeats: bool = True, similarity: float | None = None) -> DataFrame:
    """doc_id, text_hash, fp (binary, 8 bytes a word) of every row; with a similarity also `prefix`, of short texts."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.binary())] + [("prefix", pa.list_(pa.int64()))] * (similarity is not None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                some = batch.slice(at, 1000)
                fps, prefixes = [], []
                for text in some.column(2).to_pylist():
                    h = shingle_hashes(text, shingle)
                    h = h if repeats else np.unique(h)
                    fps.append(fingerprint(h, words))
                    if similarity is not None:
                        prefixes.append(prefix(np.unique(h), similarity) if 0 < len(h) <= SHORT else None)
                more = [] if similarity is None else [pa.array(prefixes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(fps, pa.binary()), *more], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, fp binary" + ", prefix array<long>" * (similarity is not None))


def blocks_for(n: int, bits: int = 64, radius: int = 4) -> int:
    """Blocks, so that the keys of blocks - radius of them have about 8 bits less than the number of rows at most."""
    blocks = radius + 2
    while bits // blocks * (blocks - radius) < n.bit_length() - 8 and blocks < 12:
        blocks += 1
    return blocks


def block_tables(bits: int = 64, blocks: int = 6, agree: int = 2) -> list[list[int]]:
    """Bit numbers of each table: the unions of `agree` of the blocks."""
    parts = np.array_split(np.arange(bits), blocks)
    return [np.concatenate(c).tolist() for c in combinations(parts, agree)]


def band_tables(bits: int, width: int) -> list[list[int]]:
    """Disjoint bands of `width` bits."""
    return [list(range(b, b + width)) for b in range(0, bits - width + 1, width)]


def links(fps: DataFrame, radius: int, tables: list[list[int]], cell: int = CELL) -> DataFrame:
    """a, b, d: links between the distinct values of fps.fp (as `node`, a long, and fp); a spanning forest of each cell."""
    ship(fps.sparkSession)
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("fp", pa.binary())])

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                some = batch.slice(at, 4000)
                if not some.num_rows:
                    continue
                fp = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint8).reshape(some.num_rows, -1)
                bits = np.unpackbits(fp, axis=1).astype(np.int64)
                for t, own in enumerate(tables):
                    key = (t << 48) + bits[:, own] @ (1 << np.arange(len(own), dtype=np.int64))
                    yield pa.RecordBatch.from_arrays([pa.array(key), some.column(0), some.column(1)], schema=schema)

    return links_within(fps.select("node", "fp").mapInArrow(keys, "key long, node long, fp binary"), radius, cell)


def links_within(bands: DataFrame, radius: int, cell: int = CELL) -> DataFrame:
    """a, b, d: links between rows (key, node, fp) of one key; a spanning forest of each cell."""
    # A crowded key's rows are dealt to groups; every two groups meet in a cell of their own.
    crowded = stored(bands.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > cell).select("key", F.ceil(F.col("n") / cell).cast("int").alias("groups")), "crowded")
    n = partitions_for(bands.sparkSession)
    if crowded.isEmpty():
        cells = bands.select("key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.lit(0).alias("grp"), "node", "fp")
    else:
        many = bands.join(crowded, "key", "left").withColumn("groups", F.coalesce("groups", F.lit(1)))
        many = many.withColumn("grp", F.pmod(F.hash("node"), "groups")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        cells = many.select("key", F.least("grp", "other").alias("lo"), F.greatest("grp", "other").alias("hi"), "grp", "node", "fp")
    dealt = cells.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "grp")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            part = _columns(batch)
            rest = part if rest is None else [np.concatenate(x) for x in zip(rest, part)]
            if len(rest[0]) >= 50_000:  # all but the last cell, which may go on in the next batch
                cut = int(np.flatnonzero(np.any(np.diff(np.stack(rest[:3]), axis=1) != 0, axis=0))[-1]) + 1 if np.any(np.diff(np.stack(rest[:3]), axis=1)) else 0
                if cut:
                    yield from _forests([x[:cut] for x in rest], radius)
                    rest = [x[cut:] for x in rest]
        if rest is not None and len(rest[0]):
            yield from _forests(rest, radius)

    return dealt.mapInArrow(compare, "a long, b long, d int").groupBy("a", "b").agg(F.min("d").alias("d"))


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    fp = batch.column(5).to_pylist()
    width = len(fp[0]) if fp else 8
    return [*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)), np.frombuffer(b"".join(fp), np.uint8).reshape(len(fp), width)]


LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.int32())])


def _forests(cols: list[np.ndarray], radius: int) -> Iterator[pa.RecordBatch]:
    """Spanning forests of whole cells, small cells together by lags, large ones by tiles of queries."""
    key, lo, hi, grp, node, fp = cols
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])])
    cell = np.cumsum(new) - 1
    size = np.bincount(cell)
    first = np.flatnonzero(new)
    wide = fp.view(np.uint64)

    def batch(i, j, d):
        keep = shortest_forest(len(node), i, j, d)
        a, b = node[i[keep]], node[j[keep]]
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), pa.array(d[keep].astype(np.int32))], schema=LINK)

    small = np.flatnonzero((size[cell] <= 64) & (size[cell] > 1))
    if len(small):
        found = [(small[i], small[j]) for i, j in close_in_runs(fp[small], cell[small], radius, int(size[cell[small]].max()))]
        if found:
            i, j = (np.concatenate(x) for x in zip(*found))
            yield batch(i, j, distances(wide, i, j))
    for c in np.flatnonzero(size > 64):
        own = np.arange(first[c], first[c] + size[c])
        across = lo[own[0]] != hi[own[0]]
        asked = own[grp[own] == lo[own[0]]] if across else own
        rows = own[grp[own] == hi[own[0]]] if across else own
        i, j, d = (np.zeros(0, np.int64) for _ in range(3))
        for q, r in close_to(fp[asked], fp[rows], radius):
            q, r = asked[q], rows[r]
            keep = (q != r) if across else (q < r)
            q, r = q[keep], r[keep]
            if not len(q):
                continue
            i, j, d = np.concatenate([i, q]), np.concatenate([j, r]), np.concatenate([d, distances(wide, q, r)])
            forest = shortest_forest(int(size[c]), i - first[c], j - first[c], d)
            i, j, d = i[forest], j[forest], d[forest]
        if len(i):
            yield batch(i, j, d)


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest id reachable by links) of every row."""
    fps = stored(fingerprints(docs, id_col, text_col, shingle=shingle).select("doc_id", F.conv(F.hex("fp"), 16, -10).cast("long").alias("node"), "fp"), "fps")
    nodes = stored(fps.groupBy("node", "fp").agg(F.min("doc_id").alias("least")), "nodes")
    blocks = blocks_for(nodes.count(), radius=radius)
    near = components(links(nodes, radius, block_tables(64, blocks, blocks - radius)))
    roots = nodes.join(near, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(roots.join(named, "root").select("node", "component_id"), "named")
    discard(nodes)
    return fps.join(named, "node").select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def band_plan(n: int, similarity: float) -> tuple[int, int, float, float]:
    """(bits of a band, 64-bit words of a fingerprint, expected distance at the similarity, its deviation) for n
    fingerprints: bands have 8 bits less than the number of fingerprints, 12 at least, so that a band's value is shared
    by few whatever the corpus, and there are as many bands as bring 99 % of such pairs together."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    band = max(12, n.bit_length() - 8)
    words = int(np.ceil(band * np.log(0.006) / np.log(1 - (1 - share) ** band) / 64))
    bits = 64 * words
    return band, words, bits * share, float(np.sqrt(bits * share * (1 - share)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, text_hash (which together name a row), group, keep: documents whose shingle sets have a Jaccard
    similarity of at least `similarity` are linked; one row of each group has keep = true, the smallest id (a null id
    only where there is no other).

    A fingerprint differs in a share arccos(cosine) / pi of its bits, and a Jaccard similarity s means a cosine of
    2 s / (1 + s). Candidates agree on a band (see `band_plan`) and lie within the expected distance plus 3.8 deviations.
    Bits of few shingles are biased, so texts of at most SHORT shingles get candidates by an exact way besides: two
    sets that similar share one of their least shingles (`prefix`); the radius there is wide enough for them.
    Every link is then decided by the shingle sets: of the candidates' forests (`verified`), and between what those
    leave apart in a group of candidates (`exact_links`).
    """
    band, words, mean, spread = band_plan(docs.count(), similarity)
    radius = int(mean + 3.8 * spread)
    fps = fingerprints(docs, id_col, text_col, shingle=shingle, words=words, repeats=False, similarity=similarity)
    fps = stored(fps.select("doc_id", "text_hash", F.xxhash64("fp").alias("node"), "fp", "prefix"), "fps")
    named = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    nodes = stored(fps.groupBy("node").agg(F.first("fp").alias("fp"), F.first("prefix", ignorenulls=True).alias("prefix"), F.min(named).alias("least")), "nodes")
    short = nodes.where("prefix is not null").select(F.explode("prefix").alias("key"), "node", "fp")
    found = links(nodes, radius, band_tables(64 * words, band)).unionByName(links_within(short, int(mean * 1.75)))
    found = stored(found.groupBy("a", "b").agg(F.min("d").alias("d")), "links")
    # The texts behind the candidates, one for each node.
    touched = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
    asked = nodes.join(touched, "node", "left_semi").select("node", F.col("least.doc_id").alias("i"), F.col("least.text_hash").alias("h"))
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"), F.col(text_col).alias("text"))
    texts = body.join(asked, body["id"].eqNullSafe(asked["i"]) & (body["hash"] == asked["h"])).select("node", "text")
    texts = stored(texts.dropDuplicates(["node"]), "texts")
    certain = stored(verified(found.select("a", "b"), texts, shingle, similarity), "certain")
    # Each link is closed once: what is certain first, then the other candidates with one link a node of what was closed.
    inner = stored(components(certain), "inner")
    closed = inner.select(F.col("node").alias("a"), F.col("component").alias("b"))
    outer = components(closed.unionByName(found.select("a", "b").join(certain, ["a", "b"], "left_anti")))
    members = outer.withColumnRenamed("component", "wide").join(inner.withColumnRenamed("component", "label"), "node", "left").select("node", "wide", F.coalesce("label", "node").alias("label"))
    members = stored(members, "members")
    near = components(closed.unionByName(exact_links(members, texts, shingle, similarity)))
    discard(texts, found, certain, members, inner)
    roots = nodes.join(near, "node", "left").select("node", "least", F.coalesce("component", "node").alias("root"))
    kept = roots.groupBy("root").agg(F.min("least").alias("kept"))
    roots = stored(roots.join(kept, "root").select("node", "root", F.col("kept.doc_id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash")), "roots")
    discard(nodes)
    return fps.join(roots, "node").select("doc_id", "text_hash", F.col("root").alias("group"), (F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))).alias("keep"))


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose texts' shingle sets reach the similarity."""
    ship(pairs.sparkSession)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            out = []
            for a, b, left, right in zip(*(c.to_pylist() for c in batch.columns)):
                if a != last:
                    last, own = a, np.unique(shingle_hashes(left, shingle))
                other = np.unique(shingle_hashes(right, shingle))
                if min(len(own), len(other)) >= similarity * max(len(own), len(other)):
                    common = len(np.intersect1d(own, other, assume_unique=True))
                    if common >= similarity * (len(own) + len(other) - common) - 1e-9:
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)], schema=schema)

    left, right = (texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    # Dealt by both ends, so that a text with very many candidates doesn't meet them all in one task.
    dealt = both.repartition(partitions_for(pairs.sparkSession), F.col("a"), F.pmod(F.hash("b"), F.lit(64))).sortWithinPartitions("a")
    return dealt.mapInArrow(run, "a long, b long")


def exact_links(members: DataFrame, texts: DataFrame, shingle: int, similarity: float, cell_chars: int = 2_000_000, cell_rows: int = 512) -> DataFrame:
    """a, b: links between nodes of one `wide` group whose shingle sets reach the similarity, enough of them to
    join all labels that any such link joins. Groups of one label have nothing to decide. A large group is dealt to
    sub-groups of about cell_chars and cell_rows at most, every two of which meet in a cell."""
    ship(members.sparkSession)
    open_ = members.groupBy("wide").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("wide")
    texts = stored(members.join(open_, "wide", "left_semi").join(texts, "node").select("node", "wide", "label", "text"), "open")
    sizes = texts.groupBy("wide").agg(F.greatest(F.ceil(F.sum(F.coalesce(F.length("text"), F.lit(0))) / cell_chars), F.ceil(F.count("*") / cell_rows)).cast("int").alias("groups"))
    many = texts.join(sizes, "wide").withColumn("groups", F.greatest("groups", F.lit(1)))
    many = many.withColumn("grp", F.pmod(F.hash("node"), "groups")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    cells = many.select("wide", F.least("grp", "other").alias("lo"), F.greatest("grp", "other").alias("hi"), "grp", "node", "label", "text")
    dealt = cells.repartition(partitions_for(members.sparkSession), "wide", "lo", "hi").sortWithinPartitions("wide", "lo", "hi")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []

        def solved() -> pa.RecordBatch:
            pairs = cell_links(rows, key[1] != key[2], key[1], shingle, similarity)
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], schema=schema)

        for batch in batches:
            for *cell, grp, node, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if cell != key:
                    if len(rows) > 1:
                        yield solved()
                    key, rows = cell, []
                rows.append((grp, node, label, np.unique(shingle_hashes(text, shingle))))
        if len(rows) > 1:
            yield solved()

    return dealt.mapInArrow(run, "a long, b long")


def cell_links(rows: list[tuple], across: bool, lo: int, shingle: int, similarity: float) -> list[tuple[int, int]]:
    """Links (node, node) of one cell of (group, node, label, sorted shingle hashes). Each document is counted against
    those of other labels at once, by marking its shingles; labels that a link joins are one from then on."""
    names = {x: k for k, x in enumerate(dict.fromkeys(r[2] for r in rows))}
    root = np.array([names[r[2]] for r in rows])
    size = np.array([len(r[3]) for r in rows])
    seen, flat = np.unique(np.concatenate([r[3] for r in rows]), return_inverse=True)
    stop = np.cumsum(size)
    mark = np.zeros(len(seen) + 1, np.int64)
    out: list[tuple[int, int]] = []
    side = np.array([r[0] == lo for r in rows])
    for i in range(len(rows)):
        other = root != root[i]
        if not other.any():
            if not (root != root[0]).any():
                break
            continue
        other &= (size >= similarity * size[i] - 1e-9) & (size[i] >= similarity * size - 1e-9)
        if across:
            other &= side != side[i]
        at = np.flatnonzero(other)
        if not len(at):
            continue
        own = flat[stop[i] - size[i] : stop[i]]
        mark[own] = 1
        picked = np.concatenate([flat[stop[k] - size[k] : stop[k]] for k in at])
        ends = np.cumsum(size[at])
        total = np.concatenate([[0], np.cumsum(mark[picked])])
        common = total[ends] - total[ends - size[at]]
        mark[own] = 0
        for k in at[common >= similarity * (size[i] + size[at] - common) - 1e-9]:
            if root[k] != root[i]:
                out.append((rows[i][1], rows[k][1]))
                root[root == root[k]] = root[i]
    return out


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs with one row of each group of near-duplicates; rows repeated in id and text count as one. Rows travel as one
    struct, so their columns may have any names."""
    kept = near_duplicates(docs, id_col, text_col, **how).where("keep").select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")).distinct()
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("hash"))
    rows = own.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("hash") == F.col("kept_hash")), "left_semi")
    return rows.dropDuplicates(["id", "hash"]).select(*(F.col(f"row.`{c}`") for c in docs.columns))
