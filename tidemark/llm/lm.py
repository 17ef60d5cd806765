"""Language-model scores by deleted interpolation of word n-grams (trigrams, bigrams, unigrams).

p(w | u v) = a c(u v w) / c(u v) + b c(v w) / c(v) + d c(w) / N + e / (V + 1). The weights a, b, d, e depend on the bucket
of the context's frequency: c(u v) where u v was seen, else c(v). They are learned by expectation-maximisation on
held-out counts: every training occurrence is scored with itself deleted from the counts. So are the documents that were
learned from (base_score keeps all counts): what a text says of itself is no evidence for it, their scores compare with
those of held-out documents, and a text that stands in the corpus twice stands out.

The work in Spark, all over whole texts and all documents:

1. Each task turns its documents into blocks of at most block_bytes. A block's distinct n-grams become sorted arrays of
   hashes with their training counts, cut by hash range into ranges that all blocks share.
2. Grouped by range, the counts are summed and each block gets the totals of its own n-grams back, without names, in
   the order in which it sent them. A word that is everywhere is one entry per block. Beyond 2 ** fan ranges this goes
   over two levels: about as many blocks as there are coarse ranges are merged in each coarse range first, and the
   merged lists go on to the fine ranges, so that the number of records grows with the input and not with its square.
3. Grouped by block, totals meet the documents, which become arrays of counts (of each word, bigram and trigram), and
   the block's histogram of deleted counts. Both are written to the shared folder.
4. The summed histogram (at most CELLS entries, whatever the corpus) gives the weights, and the arrays the scores.

Counts are as wide as their largest needs, up to 8 bytes. Unigrams are told apart by 64 bits of hash; longer n-grams by
40 bits within a range of a few million: two are merged with a chance of a few in a million.

Steps 1 and 3 cut the same blocks from the same partitions, so `docs` must read the same rows in the same order each
time, as files do; write other inputs first. A block whose n-grams differ raises an error instead of a wrong score.

Defined cases: null and empty texts are the end token alone; null ids are learned from and scored; repeated rows count
as often as they occur; with no training document all counts are 0; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, stored

END = np.uint64(0x9E3779B97F4A7C15)
#: Buckets of the context's count, for seen and for unseen contexts of two words; the last one is open.
DEGREES = 32
BUCKETS = 2 * DEGREES
#: Bins of the deleted estimates: trigram and bigram ratios (two to a power of two, the last for 0), word counts (powers of two).
TRI, BI, UNI = 24, 32, 40
CELLS = BUCKETS * TRI * BI * UNI
#: Bits that tell apart the bigrams and trigrams of a range.
WITHIN = 40
LISTS = "owner long, slot int, kind int, keys binary, counts binary"
TOTALS = "owner long, slot int, kind int, totals binary, n long, v long"


def schema_of(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ddl.split(", ")])


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and its end token, one after another, and each text's number of tokens."""
    from xxhash import xxh3_64_intdigest as h

    end = np.array([END], np.uint64)
    parts, lengths = [], []
    for text in texts:
        words = (text or "").encode().lower().split()
        parts += [np.fromiter(map(h, words), np.uint64, len(words)), end]
        lengths.append(len(words) + 1)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.array(lengths, np.int64)


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = a * np.uint64(0xBF58476D1CE4E5B9) + b
    z = (z ^ (z >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(29))


def orders(t: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token, of it with the one before, and with the two before. A text begins after two end tokens."""
    one = np.concatenate([[END], t[:-1]])
    two = np.concatenate([[END], one[:-1]])
    two[one == END] = END
    return [t, _joined(one, t), _joined(_joined(two, one), t)]


def planes(a: np.ndarray) -> bytes:
    """Counts as byte planes (all lowest bytes, then all next ones), as many as the largest needs; the first byte says how many."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def counts_of(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    full = np.zeros((raw.shape[1], 8), np.uint8)
    full[:, :width] = raw.T
    return full.view("<i8").ravel()


def short(keys: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def long_of(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    full = np.zeros((len(raw), 8), np.uint8)
    full[:, :width] = raw
    return full.view("<u8").ravel()


def ngrams(t: np.ndarray, bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted distinct keys, index of each token's key) for words, bigrams and trigrams. Words keep 64 bits, the others
    `bits` for the range and WITHIN inside it."""
    return [np.unique(h >> np.uint64(64 - bits - WITHIN if kind else 0), return_inverse=True) for kind, h in enumerate(orders(t))]


def cut(keys: np.ndarray, counts: np.ndarray, kind: int, bits: int, slot_bits: int) -> Iterator[tuple[int, bytes, bytes]]:
    """(slot, keys within the slot, counts) of sorted keys, in 2 ** slot_bits slots."""
    low = (64 if not kind else bits + WITHIN) - slot_bits
    starts = np.flatnonzero(np.append(True, keys[1:] >> np.uint64(low) != keys[:-1] >> np.uint64(low))) if len(keys) else np.zeros(0, int)
    for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)]):
        yield int(keys[a] >> np.uint64(low)), short(keys[a:b], _width(kind, bits, slot_bits)), planes(counts[a:b])


def _width(kind: int, bits: int, slot_bits: int) -> int:
    return 8 if not kind else (bits + WITHIN - slot_bits + 7) // 8


def _whole(data: bytes, kind: int, bits: int, slot_bits: int, slot: int) -> np.ndarray:
    """The keys of a list, with their slot's bits again."""
    width = _width(kind, bits, slot_bits)
    keys = long_of(data, width)
    if not kind:
        return keys
    low = bits + WITHIN - slot_bits
    return (keys & np.uint64((1 << low) - 1)) | np.uint64(slot << low)


def blocks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[int, list, list]]:
    """(block, ids, texts): the partition's documents in order, at most about `limit` characters to a block."""
    number, ids, texts, size = TaskContext.get().partitionId() << 32, [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids.append(doc)
            texts.append(text)
            size += len(text or "") + 8
            if size >= limit:
                yield number, ids, texts
                number, ids, texts, size = number + 1, [], [], 0
    if ids:
        yield number, ids, texts


def is_training(ids: list[int | None], parts: int, rest: int) -> np.ndarray:
    return np.array([d is None or zlib.crc32(str(d).encode()) % parts != rest for d in ids], bool)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


def merged(group: pa.Table, bits: int, slot_bits: int) -> Iterator[tuple[int, list[int], list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """For each kind in the lists of one slot: kind, the rows, their lengths, distinct keys, index of each entry, summed counts."""
    kinds = group.column("kind").to_numpy()
    for kind in (0, 1, 2):
        rows = np.flatnonzero(kinds == kind)
        if not len(rows):
            continue
        # In a fixed order, so that the same lists give the same answer when they are read again.
        order = np.lexsort((group.column("owner").to_numpy()[rows], group.column("slot").to_numpy()[rows]))
        rows = rows[order].tolist()
        keys = [_whole(group.column("keys")[i].as_py(), kind, bits, slot_bits, group.column("slot")[i].as_py()) for i in rows]
        counts = np.concatenate([counts_of(group.column("counts")[i].as_py()) for i in rows])
        distinct, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, at, counts)
        yield kind, rows, [len(k) for k in keys], distinct, at, total


def summed(lists: DataFrame, bits: int, slot_bits: int) -> DataFrame:
    """Columns of TOTALS: for each list (columns of LISTS) the sums of its n-grams over all lists of its slot."""
    back = schema_of(TOTALS)

    def add(group: pa.Table) -> pa.Table:
        out = []
        for kind, rows, lengths, _, at, total in merged(group, bits, slot_bits):
            known = (int(total.sum()), int((total > 0).sum())) if not kind else (0, 0)
            ends = np.cumsum(lengths).tolist()
            for i, a, b in zip(rows, [0, *ends], ends):
                out.append((group.column("owner")[i].as_py(), group.column("slot")[i].as_py(), kind, planes(total[at[a:b]]), *known))
                known = (0, 0)
        return table_of(out, back)

    return lists.groupBy("slot").applyInArrow(add, TOTALS)


def summed_twice(lists: DataFrame, bits: int, coarse: int) -> DataFrame:
    """summed() over two levels: lists of 2 ** coarse slots are merged in cells of about 2 ** coarse owners each, and the
    cells' lists are summed by fine range."""
    n = max(1, -(-lists.select("owner").distinct().count() // (1 << coarse)))
    cell = F.col("slot").cast("long") * n + F.pmod(F.xxhash64("owner"), F.lit(n))
    lists = stored(lists.withColumn("cell", cell), "lists")
    sent, back = schema_of(LISTS), schema_of(TOTALS)

    def merge(group: pa.Table) -> pa.Table:
        out, owner, slot = [], group.column("cell")[0].as_py(), group.column("slot")[0].as_py()
        for kind, _, _, distinct, _, total in merged(group, bits, coarse):
            out += [(owner, fine, kind, k, c) for fine, k, c in cut(distinct, total, kind, bits, bits)]
        return table_of(out, sent)

    fine = summed(lists.groupBy("cell").applyInArrow(merge, LISTS), bits, bits).withColumnRenamed("owner", "cell").withColumnRenamed("slot", "fine")

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        out, kinds, place = [], right.column("kind").to_numpy(), right.column("fine").to_numpy()
        sums = [int(right.column(c).to_numpy().sum()) for c in ("n", "v")]
        for kind, rows, lengths, _, at, _ in merged(left, bits, coarse):
            own = np.flatnonzero(kinds == kind)
            total = np.concatenate([counts_of(right.column("totals")[int(i)].as_py()) for i in own[np.argsort(place[own])]])
            ends = np.cumsum(lengths).tolist()
            for i, a, b in zip(rows, [0, *ends], ends):
                out.append((left.column("owner")[i].as_py(), left.column("slot")[i].as_py(), kind, planes(total[at[a:b]]), *sums))
                sums = [0, 0]
        return table_of(out, back)

    return lists.groupBy("cell").cogroup(fine.groupBy("cell")).applyInArrow(spread, TOTALS)


def packed(ids: list, texts: list) -> bytes:
    """Documents as a compressed Arrow stream."""
    batch = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, parts: int = 7, rest: int = 2, block_bytes: int = 6_000_000, range_bytes: int = 6_000_000, fan: int = 13, rounds: int = 60) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Documents whose crc32 of the id as text,
    modulo `parts`, is `rest` are held out; the others are learned from."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = own.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = min(24, max(2, int(np.ceil(np.log2(max(1, size / range_bytes))))))
    slot_bits = bits if bits <= fan else (bits + 1) // 2
    sent = schema_of(LISTS)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, block_bytes):
            t, n = tokens(texts)
            learned = np.repeat(is_training(ids, parts, rest), n)
            for kind, (keys, at) in enumerate(ngrams(t, bits)):
                counts = np.bincount(at[learned], minlength=len(keys))
                for slot, k, c in cut(keys, counts, kind, bits, slot_bits):
                    yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip((block, slot, kind, k, c), sent.types)], schema=sent)

    lists = own.mapInArrow(send, LISTS)
    totals = stored(summed(lists, bits, bits) if slot_bits == bits else summed_twice(lists, bits, slot_bits), "totals", "zstd")

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, texts in blocks(batches, block_bytes):
            for number, at in enumerate(range(0, len(ids), 2000)):
                row = (block, number, packed(ids[at : at + 2000], texts[at : at + 2000]))
                yield pa.RecordBatch.from_arrays([pa.array([x], y) for x, y in zip(row, (pa.int64(), pa.int32(), pa.binary()))], names=["owner", "part", "docs"])

    bodies = own.mapInArrow(label, "owner long, part int, docs binary")
    # One table of two kinds of rows: documents (their arrays of counts), and a block's histogram with its sums of N and V.
    columns = "doc_id long, learned boolean, words binary, pairs binary, triples binary, ends long, cells array<long>, weights array<long>, n long, v long"
    kept = schema_of(columns)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, texts = [], []
        for i in np.argsort(left.column("part").to_numpy()).tolist():
            part = pa.ipc.open_stream(left.column("docs")[i].as_py()).read_all()
            ids += part.column("doc_id").to_pylist()
            texts += part.column("text").to_pylist()
        t, n = tokens(texts)
        learned = is_training(ids, parts, rest)
        kind, order = right.column("kind").to_numpy(), right.column("slot").to_numpy()
        found = []
        for k, (keys, at) in enumerate(ngrams(t, bits)):
            rows = np.flatnonzero(kind == k)
            rows = rows[np.argsort(order[rows])]
            total = np.concatenate([counts_of(right.column("totals")[int(i)].as_py()) for i in rows])
            if len(total) != len(keys):
                raise ValueError("a block's n-grams differ from those that it counted: docs gave other rows when read again")
            found.append(total[at])
        words, pairs, triples = found
        ends = int(words[-1])
        stop = np.cumsum(n).tolist()
        first = np.concatenate([[0], stop[:-1]]).astype(np.int64)
        cells, weights = histogram(words, pairs, triples, *contexts(words, pairs, ends, first), np.repeat(learned, n))
        rows = [(d, bool(y), planes(words[a:b]), planes(pairs[a:b]), planes(triples[a:b]), ends, None, None, None, None) for d, y, a, b in zip(ids, learned, [0, *stop], stop)]
        sums = [int(right.column(c).to_numpy().sum()) for c in ("n", "v")]
        rows.append((None, None, None, None, None, None, cells.tolist(), weights.tolist(), *sums))
        return table_of(rows, kept)

    table = stored(bodies.groupBy("owner").cogroup(totals.groupBy("owner")).applyInArrow(meet, columns), "counts", "zstd")
    discard(totals)
    sums = table.where("n is not null").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    big_n, big_v = int(sums["n"]), int(sums["v"])
    cells = table.where("cells is not null").select(F.explode(F.arrays_zip("cells", "weights")).alias("c")).groupBy("c.cells").agg(F.sum("c.weights").alias("w"))
    found = cells.orderBy("cells").toArrow()  # at most CELLS rows
    mix = learn_weights(found.column(0).to_numpy(), found.column(1).to_numpy().astype(float), big_n, big_v, rounds)
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scores = schema_of(result)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, learned, *counts, ends in zip(*(c.to_pylist() for c in batch.columns)):
                w, p, q = map(counts_of, counts)
                base = np.log10((w + 1) / (big_n + big_v + 1)).sum()
                own = [x - int(learned) for x in (w, p, q, *contexts(w, p, ends, np.zeros(1, np.int64)))]
                prob = probability(mix, *own, big_n - int(learned), big_v)
                out.append((doc, not learned, len(w), int((w > 0).sum()), big_n, float(base), float(np.log10(prob).sum())))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(zip(*out), scores.types)], schema=scores)

    return table.where("n is null").select("doc_id", "learned", "words", "pairs", "triples", "ends").mapInArrow(score, result)


def contexts(words: np.ndarray, pairs: np.ndarray, ends: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the word and of the two words before each token. Before a text's first token stands the end of another
    one, and before that one too: both are as frequent as texts."""
    one, two = np.concatenate([[0], words[:-1]]), np.concatenate([[0], pairs[:-1]])
    one[first], two[first] = ends, ends
    return one, two


def bucket(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The context's bucket, by the count of the two words before where they were seen, else of the word before. Counts
    of 0 to 3 have their own, larger ones share one to a power of two."""
    degree = lambda c: np.where(c > 3, np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64) + 2, DEGREES - 1), c).astype(np.int64)
    return np.where(two > 0, degree(two), DEGREES + degree(one))


def _ratio_bin(x: np.ndarray, bins: int) -> np.ndarray:
    """Bins of numbers in (0, 1]: two to a power of two; the last bin is for 0."""
    return np.where(x > 0, np.minimum(bins - 2, np.round(-2 * np.log2(np.maximum(x, 1e-300)))), bins - 1).astype(np.int64)


def histogram(words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, one: np.ndarray, two: np.ndarray, learned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells and how many training tokens fall into each: bucket of the context, bins of c(uvw) / c(uv), c(vw) / c(v)
    and c(w), each count less the token itself."""
    w, p, q, u, uv = (x[learned].astype(float) - 1 for x in (words, pairs, triples, one, two))
    tri, bi = np.where(uv > 0, q / np.maximum(uv, 1), 0), np.where(u > 0, p / np.maximum(u, 1), 0)
    uni = np.where(w > 0, np.minimum(np.round(np.log2(np.maximum(w, 1))), UNI - 2), UNI - 1).astype(np.int64)
    cell = ((bucket(u, uv) * TRI + _ratio_bin(tri, TRI)) * BI + _ratio_bin(bi, BI)) * UNI + uni
    return np.unique(cell, return_counts=True)


def probability(mix: np.ndarray, words: np.ndarray, pairs: np.ndarray, triples: np.ndarray, one: np.ndarray, two: np.ndarray, n: int, v: int) -> np.ndarray:
    m = mix[bucket(one, two)]
    tri, bi = np.where(two > 0, triples / np.maximum(two, 1), 0), np.where(one > 0, pairs / np.maximum(one, 1), 0)
    return m[:, 0] * tri + m[:, 1] * bi + m[:, 2] * words / max(n, 1) + m[:, 3] / (v + 1)


def learn_weights(cells: np.ndarray, weights: np.ndarray, n: int, v: int, rounds: int) -> np.ndarray:
    """(BUCKETS, 4): weights of the trigram, bigram, unigram and uniform estimates for each bucket, by EM from equal
    weights. A thousand tokens of the whole corpus's weights are added to each bucket, so that rare buckets are not
    extreme; an estimate that a bucket's context can't have gets no weight."""
    have = np.ones((BUCKETS, 4), bool)
    have[DEGREES:, 0] = False
    have[DEGREES, 1] = False
    have[0, :2] = False
    out = have / have.sum(axis=1, keepdims=True)
    if not len(cells):
        return np.tile([0.0, 0.0, 0.0, 1.0], (BUCKETS, 1))
    b, q, p, w = cells // (TRI * BI * UNI), cells // (BI * UNI) % TRI, cells // UNI % BI, cells % UNI
    ratio = lambda k, bins: np.where(k == bins - 1, 0.0, 2.0 ** (-k / 2))
    uni = np.where(w == UNI - 1, 0.0, 2.0**w) / max(1, n - 1)
    parts = np.stack([ratio(q, TRI), ratio(p, BI), uni, np.full(len(cells), 1 / (v + 1))], axis=1)

    def shares(m: np.ndarray) -> np.ndarray:
        x = m * parts
        return x / np.maximum(x.sum(axis=1, keepdims=True), 1e-300) * weights[:, None]

    seen = b < DEGREES
    for part in (seen, ~seen):
        whole = np.full(4, 1 / 4)
        for _ in range(rounds):
            whole = shares(whole)[part].sum(axis=0)
            whole /= max(whole.sum(), 1e-300)
        rows = slice(0, DEGREES) if part is seen else slice(DEGREES, BUCKETS)
        prior = np.maximum(whole, 1e-9) * have[rows]
        for _ in range(rounds):
            s = shares(out[b])
            new = np.stack([np.bincount(b, s[:, k], BUCKETS) for k in range(4)], axis=1)[rows] * have[rows] + 1000 * prior
            out[rows] = new / new.sum(axis=1, keepdims=True)
    return out
