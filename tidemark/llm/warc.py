"""WARC archives in seekable Zstandard bundles.

`plan_records` decides, with a hash aggregate and an equi-join, which of the records with one payload is the response
and which revisit it. `write_warc` serialises records, compresses groups of them as independent Zstandard frames and
ends each bundle with a seek table (a skippable frame: compressed and decompressed size of each frame). A bundle row
holds the bytes and an index that maps record identifiers to (frame, offset in the decompressed frame, length).
`read_warc` reads bundles back through the seek table; `read_records` decompresses only the frames it needs.

Defined cases: null html is an empty payload; a null page id gives an identifier of its own (read back as null) and
never is the one that others refer to, so null rows are responses unless a numbered row has their payload; rows that
repeat a page id and its payload are all responses when theirs is the largest; an empty table gives no bundle; other
columns are not read; null urls are written as urn:none.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored, text_bytes

# Fixed values of the seekable format and of WARC.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

BUNDLE = "bundle string, n_records long, data binary, record_ids array<string>, frames array<int>, offsets array<long>, lengths array<long>"
RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, record_type, refers_to for every row. Payloads of min_bytes or more are stored once."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), text_bytes(html_col).alias("payload"))
    # A smaller payload has a key of its own that matches nothing, so that these rows are spread.
    alone = F.concat(F.lit("alone:"), F.xxhash64("page_id", "url", "payload").cast("string"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")).otherwise(alone))
    # max() is combined before the shuffle, so a payload that a third of the rows share is one row per task; only
    # payloads that occur again take part in the join, whose crowded keys adaptive execution splits.
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").drop("n")
    rows = rows.join(first, "digest", "left")
    refers = F.when(F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.col("keeper"))
    return rows.select("page_id", "url", "payload", F.when(refers.isNull(), "response").otherwise("revisit").alias("record_type"), refers.alias("refers_to"))


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:page:{'null' + salt if page_id is None else page_id}>"


def page_of(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP header alone; its digest and length are those of the full payload."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = "".join(c for c in url or "urn:none" if c not in "\r\n")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if kind == "revisit" else http + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of RECORD from one record's bytes; the digest is of the stored payload where there is one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: ")).split(": ")[1])
    kind = fields["WARC-Type"]
    digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
    if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"record_id": fields["WARC-Record-ID"], "record_type": kind, "target_uri": fields["WARC-Target-URI"], "refers_to": fields.get("WARC-Refers-To"), "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None}


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *x) for x in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frame_spans(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, decompressed size) of each frame, from the footer alone."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    step = 12 if flags & 0x80 else 8
    at, start, out = len(data) - 9 - n * step, 0, []
    for i in range(n):
        packed, full = struct.unpack_from("<II", data, at + i * step)
        out.append((start, packed, full))
        start += packed
    return out


def read_frame(data: bytes, span: tuple[int, int, int]) -> bytes:
    start, packed, full = span
    return zstandard.ZstdDecompressor().decompress(data[start : start + packed], max_output_size=full)


def write_warc(records: DataFrame, *, frame_bytes: int = 256_000, bundle_bytes: int = 16_000_000, level: int = 3, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Bundles (columns of BUNDLE) of plan_records' rows, written to the shared folder and read back."""
    ship(records.sparkSession)
    schema = pa.schema([("bundle", pa.string()), ("n_records", pa.int64()), ("data", pa.binary()), ("record_ids", pa.list_(pa.string())), ("frames", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, packer = TaskContext.get().partitionId(), 0, zstandard.ZstdCompressor(level=level)
        done: list[bytes] = []
        sizes: list[tuple[int, int]] = []
        index: list[tuple[str, int, int, int]] = []
        frame, filled = bytearray(), 0

        def close_frame() -> None:
            nonlocal frame, filled
            if frame:
                done.append(packer.compress(bytes(frame)))
                sizes.append((len(done[-1]), len(frame)))
                filled += len(frame)
                frame = bytearray()

        def bundle() -> pa.RecordBatch:
            row = [f"{part:06d}-{number:06d}", len(index), b"".join(done) + seek_table(sizes), *([x[i] for x in index] for i in range(4))]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, schema.types)], schema=schema)

        for batch in batches:
            for page, url, payload, kind, refers in zip(*(c.to_pylist() for c in batch.columns)):
                data = record(page, url, payload, kind, refers, date)
                index.append((record_id(page), len(sizes), len(frame), len(data)))
                frame += data
                if len(frame) >= frame_bytes:
                    close_frame()
                if filled >= bundle_bytes:
                    yield bundle()
                    done, sizes, index, filled, number = [], [], [], 0, number + 1
        close_frame()
        if index:
            yield bundle()

    return stored(records.select("page_id", "url", "payload", "record_type", "refers_to").mapInArrow(write, BUNDLE), "warc")


def read_warc(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """Every record (columns of RECORD) of the bundles, each frame decompressed once."""
    return _read(bundles.select("data", "record_ids", "frames", "offsets", "lengths"), payloads)


def read_records(bundles: DataFrame, ids: list[str]) -> DataFrame:
    """The named records alone: other bundles are filtered out, other frames are not decompressed."""
    wanted = F.array(*map(F.lit, ids))
    some = bundles.where(F.arrays_overlap("record_ids", wanted)).withColumn("at", F.filter(F.arrays_zip("record_ids", "frames", "offsets", "lengths"), lambda x: F.array_contains(wanted, x["record_ids"])))
    return _read(some.select("data", *(F.col("at")[c].alias(c) for c in ("record_ids", "frames", "offsets", "lengths"))), True)


def _read(rows: DataFrame, payloads: bool) -> DataFrame:
    ship(rows.sparkSession)
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = pa.schema(list(zip(names, types)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column(0)[i].as_py()
                spans, last, text, out = frame_spans(data), None, b"", []
                for frame, offset, length in sorted(zip(*(batch.column(k)[i].as_py() for k in (2, 3, 4)))):
                    if frame != last:
                        last, text = frame, read_frame(data, spans[frame])
                    found = parse(text[offset : offset + length])
                    if not payloads:
                        found["payload"] = None
                    out.append(found)
                    if len(out) >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out = []
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(read, RECORD)
