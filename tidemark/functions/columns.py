"""Scalar functions as column expressions: keys, versions, sessions, clocks, formats."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a key part escapes: the separator, the escape itself, controls, delete.
ESCAPED = [37, 58, *range(32), 127]


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    day = F.unix_date(ts.cast("date")).cast("long") * 86_400_000
    return day + F.hour(ts) * 3_600_000 + F.minute(ts) * 60_000 + F.floor(F.extract(F.lit("SECOND"), ts) * 1000).cast("long")


def escape_part(part: Column) -> Column:
    """Percent-escapes a key part; the escape sign goes first so that nothing is escaped twice."""
    return reduce(lambda c, code: F.replace(c, F.lit(chr(code)), F.lit(f"%{code:02X}")), ESCAPED, part.cast("string"))


def unescape_part(part: Column) -> Column:
    """Inverse of escape_part; hexadecimal digits in either case; null where an escape is damaged."""
    damaged = part.rlike("%(?![0-9A-Fa-f]{2})")
    pieces = F.split(part, "%")
    # Bytes, so that escaped parts of a multi-byte character join up again.
    decoded = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.concat(F.unhex(F.substring(p, 1, 2)), F.encode(F.substring(p, F.lit(3), F.length(p)), "utf-8")))
    whole = F.aggregate(decoded, F.encode(pieces[0], "utf-8"), lambda a, b: F.concat(a, b))
    return F.when(~damaged, F.decode(whole, "utf-8"))


def format_key(table: str, *parts: Column) -> Column:
    """table:part[:part...], one to one."""
    return F.concat_ws(":", F.lit(table), *map(escape_part, parts))


def valid_key(key: Column) -> Column:
    return F.coalesce(key.rlike(r"^[A-Za-z_][A-Za-z0-9_$]{0,63}(:([^:%\x00-\x1f\x7f]|%[0-9A-Fa-f]{2})*)+$"), F.lit(False))


def parse_key(key: Column) -> Column:
    """struct(table, parts) of a valid key, else null."""
    pieces = F.split(key, ":")
    return F.when(valid_key(key), F.struct(pieces[0].alias("table"), F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), unescape_part).alias("parts")))


def canonical_uint(text: Column, bits: int = 64) -> Column:
    """An unsigned number in its one spelling (no sign, no leading zeros, in range), else null."""
    value = F.when(text.rlike("^(0|[1-9][0-9]{0,19})$"), text.cast("decimal(20,0)"))
    return F.when(value <= F.lit(str(2**bits - 1)).cast("decimal(20,0)"), value)


def padded_version(v: Column) -> Column:
    """20 digits, so that text order is number order."""
    return F.lpad(v.cast("string"), 20, "0")


def hlc(ms: Column, logical: Column) -> Column:
    """A hybrid logical clock reading: 48 bits of milliseconds, 16 of a counter."""
    return F.shiftleft(ms.cast("long"), 16) + logical


def hlc_ms(v: Column) -> Column:
    return F.shiftrightunsigned(v, 16)


def hlc_logical(v: Column) -> Column:
    return v.bitwiseAND(F.lit(65535))


def quote_identifier(name: Column) -> Column:
    return F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))


def fill_template(template: Column, key: Column) -> Column:
    return F.replace(template, F.lit("{key}"), key)


def encode_session(watermarks: Column) -> Column:
    """shard:version,... in shard order, of a map of shard to version."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(watermarks)), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")


def decode_session(text: Column) -> Column:
    pairs = F.transform(F.filter(F.split(text, ","), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^(.*):", 1).alias("key"), F.regexp_extract(p, ":([0-9]+)$", 1).cast("long").alias("value")))
    return F.map_from_entries(pairs)


def merge_sessions(a: Column, b: Column) -> Column:
    """The larger watermark of each shard."""
    return F.map_zip_with(a, b, lambda k, x, y: F.greatest(x, y))


def projection(*cols: Column) -> Column:
    """A row's values joined so that null, empty and missing stay apart: 0 between values, ff for null."""
    parts = [F.coalesce(c.cast("string").cast("binary"), F.lit(b"\xff")) for c in cols]
    return reduce(lambda a, b: F.concat(a, F.lit(b"\x00"), b), parts)


def ratio(reads: Column, writes: Column) -> Column:
    """reads / writes; 0 without either, infinite without writes."""
    return F.when(writes > 0, reads / writes).when(reads > 0, F.lit(float("inf"))).otherwise(F.lit(0.0))


def shed_probability(failures: Column, total: Column, min_requests: int = 20, floor: float = 0.05, most: float = 0.95) -> Column:
    """How much of a node's traffic to shed at its failure rate."""
    rate = failures / F.greatest(total, F.lit(1))
    return F.when((total < min_requests) | (rate <= floor), F.lit(0.0)).otherwise(F.least(F.lit(most), (rate - floor) / (1 - floor) * most))


def nines(observations: Column, violations: Column) -> Column:
    """Nines of consistency; without violations, what so many observations can show (the rule of three)."""
    n, v = observations.cast("double"), violations.cast("double")
    return F.when(v > 0, -F.log10(v / n)).when(n > 3, F.log10(n / 3)).otherwise(F.lit(0.0))


def format_ns(ns: Column) -> Column:
    return F.when(ns < 1e3, F.concat(F.format_number(ns, "0.0"), F.lit(" ns"))).when(ns < 1e6, F.concat(F.format_number(ns / 1e3, "0.0"), F.lit(" µs"))).otherwise(F.concat(F.format_number(ns / 1e6, "0.0"), F.lit(" ms")))


def accepts(level: Column, fill_version: Column, watermark: Column, now_ms: Column, bound_ms: Column, skew_ms: int = 250) -> Column:
    """Whether a cached entry may answer a read. The bound narrows by the clock skew; an unknown watermark accepts."""
    session = watermark.isNull() | (fill_version >= watermark)
    fresh = hlc_ms(fill_version) >= now_ms - bound_ms + skew_ms
    return F.when(level == "STRONG", F.lit(False)).when(level == "SESSION", session).when(level == "BOUNDED", session & fresh).otherwise(F.lit(True))


def check_requirement(level: str, bound_ms: int | None) -> str:
    """The level of a request, in capitals; raises on unknown levels and bounds out of place."""
    level = (level or "").strip().upper()
    level = "SESSION" if level in ("", "UNSPECIFIED") else level
    if level not in ("STRONG", "SESSION", "BOUNDED", "EVENTUAL"):
        raise ValueError(f"unknown level {level!r}")
    if (level == "BOUNDED") != bool(bound_ms and bound_ms > 0):
        raise ValueError("BOUNDED takes a positive bound, the other levels none")
    return level
