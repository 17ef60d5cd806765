"""Token ids in the Arrow file format: fixed-size lists of ids and masks, open to zero-copy random access.

Documents are dealt by range of their id, so that files hold them in ascending order. Each task encodes its documents
and closes a file at a document's end once it holds file_tokens ids. A shard is two Arrow files: `tokens` (columns
`ids`, fixed-size list of uint16 or uint32, as the vocabulary needs, and `mask`, fixed-size list of bits, false in the padding of the last row) and `docs`
(doc_id, start, n_tokens within the shard). A file's sequences lie in record batches of batch_rows, which its footer
lists: `sequence_at` opens the batch of one sequence and nothing else, and copies nothing. Shards are rows of a table in
the shared folder, so that Spark's own writer commits them, on any store. The table is not compressed, so an Arrow file
lies in its Parquet file byte for byte; who wants single files writes the `tokens` cells out (Python tasks can't write to
every store that Spark can).

Defined cases: null and empty texts have the end id alone; null ids come first; rows with one id are ordered by their
text's hash; an empty table gives no shard; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, settings, ship, stored
from .tokenizer import encoder, vocabulary

SHARD = "part int, file int, n_docs long, n_tokens long, tokens binary, docs binary"


def ids_of(data) -> tuple[np.ndarray, int]:
    """All ids of a `tokens` file in order, padding included, and how many are no padding."""
    reader = pa.ipc.open_file(pa.py_buffer(data))
    batches = [reader.get_batch(i) for i in range(reader.num_record_batches)]
    if not batches:
        return np.zeros(0, np.uint32), 0
    return np.concatenate([b.column("ids").values.to_numpy(zero_copy_only=True) for b in batches]), sum(b.column("mask").values.true_count for b in batches)


def sequence_at(data, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
    """Ids and mask of sequence i of a `tokens` file, both in the file's own memory."""
    reader = pa.ipc.open_file(pa.py_buffer(data))
    rows = reader.get_batch(0).num_rows
    row = reader.get_batch(i // rows).slice(i % rows, 1)
    return row.column("ids").flatten().to_numpy(zero_copy_only=True), row.column("mask").flatten()


def arrow_file(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_file(sink, batches[0].schema) as writer:
        for batch in batches:
            writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def token_file(ids: np.ndarray, sequence: int, batch_rows: int = 64) -> bytes:
    """Record batches of batch_rows equal-length sequences; the last sequence is padded with id 0 under mask false."""
    rows = -(-len(ids) // sequence)
    flat, mask = np.zeros(rows * sequence, ids.dtype), np.zeros(rows * sequence, bool)
    flat[: len(ids)], mask[: len(ids)] = ids, True
    step = batch_rows * sequence
    batches = []
    for at in range(0, rows * sequence, step):
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[at : at + step]), sequence) for x in (flat, mask)]
        batches.append(pa.RecordBatch.from_arrays(lists, ["ids", "mask"]))
    return arrow_file(batches)


def write_token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, vocab: str | None = None, end: int = 2, sequence: int = 2048, file_tokens: int = 500_000, partitions: int | None = None) -> DataFrame:
    """The shard table (columns of SHARD), written to the shared folder and read back."""
    spark = docs.sparkSession
    ship(spark)
    vocab = vocab or vocabulary()
    schema = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.binary()), ("docs", pa.binary())])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, file = encoder(vocab), TaskContext.get().partitionId(), 0
        kind = np.uint16 if max(enc.size, end + 1) <= 1 << 16 else np.uint32
        held: list[np.ndarray] = []
        names: list[int | None] = []
        size = 0

        def shard() -> pa.RecordBatch:
            lengths = np.fromiter(map(len, held), np.int64, len(held))
            index = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(np.cumsum(lengths) - lengths), pa.array(lengths)], ["doc_id", "start", "n_tokens"])
            row = [[part], [file], [len(held)], [size], [token_file(np.concatenate(held).astype(kind), sequence)], [arrow_file([index])]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                for name, ids in zip(some.column(0).to_pylist(), enc.encode(some.column(1).to_pylist(), end)):
                    held.append(ids)
                    names.append(name)
                    size += len(ids)
                    if size >= file_tokens:
                        yield shard()
                        held, names, size, file = [], [], 0, file + 1
        if held:
            yield shard()

    n = partitions or partitions_for(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return stored(dealt.mapInArrow(encode, SHARD), "tokens", "uncompressed")


def read_token_files(shards: DataFrame) -> DataFrame:
    """Per document doc_id, start (over all shards in order), n_tokens, ids_crc32, read from the shards' files."""
    ship(shards.sparkSession)
    out = pa.schema([("part", pa.int32()), ("file", pa.int32()), ("doc_id", pa.int64()), ("local", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, file = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, size = ids_of(batch.column(2)[i].as_buffer())
                ids = ids[:size].astype("<u4")
                docs = pa.ipc.open_file(pa.py_buffer(batch.column(3)[i].as_buffer())).read_all().combine_chunks()
                starts, lengths = docs.column("start").to_numpy(), docs.column("n_tokens").to_numpy()
                crc = [zlib.crc32(ids[s : s + n]) for s, n in zip(starts, lengths)]
                cols = [[part] * len(crc), [file] * len(crc), docs.column("doc_id").to_pylist(), starts, lengths, crc]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, out.types)], schema=out)

    spark = shards.sparkSession
    with settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "8", "spark.sql.parquet.columnarReaderBatchSize": "8"}):  # rows of megabytes
        rows = stored(shards.select("part", "file", "tokens", "docs").mapInArrow(read, "part int, file int, doc_id long, local long, n_tokens long, ids_crc32 long"), "token-docs")
    # Running sums over one row per part, then over the files of a part; never over documents.
    parts, files = Window.orderBy("part"), Window.partitionBy("part").orderBy("file")
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    per_part = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", earlier("n", parts).alias("part_start"))
    offsets = shards.select("part", "file", earlier("n_tokens", files).alias("file_start")).join(per_part, "part")
    return rows.join(offsets, ["part", "file"]).select("doc_id", (F.col("part_start") + F.col("file_start") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
