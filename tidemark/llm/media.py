"""Media columns: progressive JPEG files, stored payloads in them, and full-resolution RGB tensors.

`decode_media` reads a column of progressive files (coefficients accumulated scan by scan, see jpeg.py) to RGB tensors.
`store_payloads` keeps bytes losslessly in such files: each byte is a coefficient, by a fixed one-to-one mapping that
gives frequent bytes of text small numbers, and 64 of them are a block; `read_payloads` gets them back from the
coefficients. Pixels are a function of the payload, and features of the pixels.

Defined cases: null payloads count as empty; a null file gives null pixels; damaged files and other kinds of JPEG
raise an error; an empty table gives no rows; any columns may be kept beside the result.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from . import jpeg
from .common import ship

BLOCK = 64
#: Frequent bytes of text, most frequent first; they get the coefficients nearest to 0. The others follow by value.
FREQUENT = b" enthairosd\xc3ulc.gb,fwy\xa9mpvkjzqx\nESTAID"
#: Bytes of payload that are coded together.
CHUNK = 1_000_000
#: Rows that are unpacked together.
ROWS = 500


def byte_map() -> tuple[np.ndarray, np.ndarray]:
    """Coefficient of each byte, and byte of each coefficient + 128: byte number k of the order is 0, -1, 1, -2, 2 ..."""
    order = [*FREQUENT, *(b for b in range(256) if b not in FREQUENT)]
    value = np.zeros(256, np.int16)
    for k, b in enumerate(order):
        value[b] = -(k + 1) // 2 if k % 2 else k // 2
    back = np.zeros(257, np.uint8)
    back[value.astype(int) + 128] = np.arange(256)
    return value, back


_VALUE, _BYTE = byte_map()


def padded(payload: Column) -> Column:
    """A payload filled with bytes 0 up to a positive multiple of 64."""
    n = F.octet_length(payload)
    more = F.greatest(F.ceil(n / BLOCK) * BLOCK, F.lit(BLOCK)) - n
    return F.concat(payload, F.repeat(F.lit("\0"), more.cast("int")).cast("binary"))


def _in_chunks(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ROWS rows, so that few payloads and files are unpacked at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def store_payloads(rows: DataFrame, payload_col: str, keep: list[str], length_col: str | None = None, media_col: str = "media") -> DataFrame:
    """The columns `keep` and media_col. Payloads have a positive multiple of 64 bytes (`padded`); length_col, the
    number of bytes before padding, goes into the file's comment beside the payload's."""
    ship(rows.sparkSession)
    own = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(payload_col).alias("_payload"), (F.col(length_col) if length_col else F.octet_length(payload_col)).cast("long").alias("_n"))
    schema = StructType([*own.schema.fields[: len(keep)], StructField(media_col, BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            payloads, lengths = batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist()
            payloads = [p or bytes(BLOCK) for p in payloads]
            for part in _in_chunks([len(p) for p in payloads], CHUNK):
                values = [_VALUE[np.frombuffer(p, np.uint8)].reshape(-1, BLOCK) for p in payloads[part]]
                notes = [struct.pack(">QQ", len(p), n or 0) for p, n in zip(payloads[part], lengths[part])]
                files = jpeg.encode(values, notes)
                some = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], pa.array(files, pa.binary())], names=[*keep, media_col])

    return own.mapInArrow(run, schema)


def payload_of(image: jpeg.Image, coefs: np.ndarray) -> bytes:
    y, cb, cr = image.parts
    w, h = image.groups_wide, image.groups_high
    six = np.empty((w * h, 6, BLOCK), np.int16)
    six[:, :4] = coefs[y.row : y.row + w * h * 4].reshape(h, 2, w, 2, BLOCK).transpose(0, 2, 1, 3, 4).reshape(-1, 4, BLOCK)
    six[:, 4], six[:, 5] = coefs[cb.row : cb.row + w * h], coefs[cr.row : cr.row + w * h]
    size = struct.unpack(">QQ", image.note)[0]
    return _BYTE[six.reshape(-1)[:size] + 128].tobytes()


def describe(tensor: np.ndarray) -> str:
    """A feature: the tensor's shape, and mean and mean square of each channel in thousandths."""
    flat = tensor.reshape(-1, 3)
    counts = [np.bincount(flat[:, c], minlength=256) for c in range(3)]
    level = np.arange(256)
    sums, squares = (np.array([int((k * v).sum()) for k in counts]) for v in (level, level * level))
    return f"{tensor.shape[0]}x{tensor.shape[1]}x3 mean {' '.join(str(s * 1000 // len(flat)) for s in sums.tolist())} square {' '.join(str(s * 1000 // len(flat)) for s in squares.tolist())}"


def read_payloads(rows: DataFrame, keep: list[str], media_col: str = "media", pixels: bool = False) -> DataFrame:
    """The columns `keep`, payload and n_bytes from the stored coefficients, feature, and (if asked) height, width, rgb."""
    return _decode(rows, keep, media_col, payload=True, pixels=pixels)


def decode_media(rows: DataFrame, keep: list[str], media_col: str = "media") -> DataFrame:
    """The columns `keep`, height, width and rgb (height * width * 3 bytes, row by row) of progressive files."""
    return _decode(rows, keep, media_col, payload=False, pixels=True)


def _decode(rows: DataFrame, keep: list[str], media_col: str, payload: bool, pixels: bool) -> DataFrame:
    ship(rows.sparkSession)
    own = rows.select(*(F.col(f"`{c}`") for c in keep), F.col(media_col).alias("_media"))
    fields = [("payload", BinaryType()), ("n_bytes", LongType()), ("feature", StringType())] * payload + [("height", IntegerType()), ("width", IntegerType()), ("rgb", BinaryType())] * pixels
    schema = StructType([*own.schema.fields[: len(keep)], *(StructField(c, t) for c, t in fields)])
    kinds = {"payload": pa.binary(), "n_bytes": pa.int64(), "feature": pa.string(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            media = batch.column(len(keep)).to_pylist()
            for part in _in_chunks([len(m or b"") for m in media], CHUNK // 2):
                some = batch.slice(part.start, part.stop - part.start)
                there = [i for i, m in enumerate(media[part]) if m is not None]
                images, coefs = jpeg.coefficients([media[part][i] for i in there])
                tensors = jpeg.rgb(images, coefs)
                cols: dict[str, list] = {c: [None] * some.num_rows for c, _ in fields}
                for i, image, tensor in zip(there, images, tensors):
                    if payload:
                        cols["payload"][i], cols["n_bytes"][i], cols["feature"][i] = payload_of(image, coefs), struct.unpack(">QQ", image.note)[1], describe(tensor)
                    if pixels:
                        cols["height"][i], cols["width"][i], cols["rgb"][i] = *tensor.shape[:2], tensor.tobytes()
                yield pa.RecordBatch.from_arrays([*some.columns[: len(keep)], *(pa.array(v, kinds[c]) for c, v in cols.items())], names=[*keep, *cols])

    return own.mapInArrow(run, schema)
