"""Declared tables: columns of a closed set of types, key and version columns, fingerprints, encoded rows."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

from pyspark.sql.types import BinaryType, DataType, DecimalType, LongType, ShortType, StringType, StructField, StructType

#: The closed set of declared types and what they are in Spark.
TYPES: dict[str, DataType] = {"uint8": ShortType(), "uint32": LongType(), "uint64": DecimalType(20, 0), "int64": LongType(), "string": StringType(), "bytes": BinaryType(), "text": StringType()}
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_$]{0,63}")


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    type: str
    nullable: bool = False
    collation: str | None = None


@dataclass(frozen=True)
class TableSpec:
    name: str
    columns: tuple[ColumnSpec, ...]
    key: tuple[str, ...]
    version: str
    domain: str = "schema.v1"  # first line of what is hashed; deployments that share fingerprints share it

    def __post_init__(self):
        own = {c.name: c for c in self.columns}
        bad = [n for n in (self.name, *own) if not NAME.fullmatch(n)]
        if bad or not self.columns or len(own) < len(self.columns) or any(c.type not in TYPES for c in self.columns):
            raise ValueError(f"table {self.name}: names {bad}, columns must be distinct, of the types {sorted(TYPES)}, at least one")
        if not self.key or any(k not in own or own[k].nullable for k in self.key):
            raise ValueError(f"table {self.name}: key columns must be declared and not nullable")
        for k in self.key:
            c = own[k]
            if c.type in ("string", "text") and (not c.collation or "_ci" in c.collation or "_ai" in c.collation):
                raise ValueError(f"{k}: a text key needs a collation under which distinct keys differ")
        v = own.get(self.version)
        if v is None or v.nullable or v.type not in ("uint8", "uint32", "uint64", "int64"):
            raise ValueError(f"table {self.name}: the version column must be a declared integer and not nullable")

    @property
    def canonical(self) -> str:
        """The text that the fingerprint is taken of. Versions and collations are no part of a row's shape."""
        cols = "".join(f"{i}:{c.name}:{c.type}:{str(c.nullable).lower()}\n" for i, c in enumerate(self.columns))
        return f"{self.domain}\n{self.name}\n{cols}pk\n" + "".join(f"{k}\n" for k in self.key)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.canonical.encode()).hexdigest()[:16]

    def struct(self) -> StructType:
        return StructType([StructField(c.name, TYPES[c.type], c.nullable, {"collation": c.collation, "key": c.name in self.key}) for c in self.columns])

    def missing_from(self, live: StructType) -> list[str]:
        """Declared columns that a live table lacks or has with other nullability; extra live columns are fine."""
        there = {f.name: f for f in live.fields}
        return [c.name for c in self.columns if c.name not in there or there[c.name].nullable != c.nullable]


def encode_row(values: list[bytes | None]) -> bytes:
    """Format byte 1, a bitmap of nulls, then each value behind its length (variable-length number)."""
    bitmap = bytearray((len(values) + 7) // 8)
    body = bytearray()
    for i, v in enumerate(values):
        if v is None:
            bitmap[i // 8] |= 1 << i % 8
            continue
        n = len(v)
        while n > 127:
            body.append(n & 127 | 128)
            n >>= 7
        body.append(n)
        body += v
    return b"\x01" + bytes(bitmap) + bytes(body)


def decode_row(data: bytes, columns: int) -> list[bytes | None]:
    """Inverse of encode_row; raises ValueError on anything that encode_row can't have made."""
    at = 1 + (columns + 7) // 8
    if len(data) < at or data[0] != 1:
        raise ValueError("no row of this format")
    out: list[bytes | None] = []
    for i in range(columns):
        if data[1 + i // 8] >> i % 8 & 1:
            out.append(None)
            continue
        n = shift = 0
        while True:
            if at >= len(data) or shift > 56:
                raise ValueError("cut off")
            n |= (data[at] & 127) << shift
            shift += 7
            at += 1
            if data[at - 1] < 128:
                break
        if at + n > len(data):
            raise ValueError("cut off")
        out.append(data[at : at + n])
        at += n
    if at != len(data):
        raise ValueError("bytes left over")
    return out
