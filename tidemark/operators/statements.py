"""Statement kinds over a query log, told by patterns in the conservative way: whatever isn't plainly a point read or
write of one declared table passes through, and a write of that table whose row can't be told is opaque. No parser:
columns of a DataFrame, regular expressions and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import canonical_uint, escape_part

READ = r"^select (.+?) from (\S+) where (.+?)( limit 1)?$"
UPDATE = r"^update (\S+) set (.+) where (.+)$"
DELETE = r"^delete from (\S+) where (.+)$"
WRITE = r"^(?:update|delete from|insert (?:ignore )?into|replace into|truncate (?:table )?)\s*([^\s(]+)"
TERM = r"^`?([a-z_][a-z0-9_$]*)`? ?= ?([0-9]+|\?)$"


def normalised(sql: Column) -> Column:
    """Lower case, comments and surplus white space removed; null where comments could hide something or where there
    is more than one statement."""
    text = F.lower(sql)
    odd = text.rlike(r"/\*[!+]|--\S|;\s*\S") | (F.regexp_replace(text, r"/\*.*?\*/", "").contains("/*"))
    plain = F.regexp_replace(F.regexp_replace(text, r"/\*.*?\*/", " "), r"(-- [^\n]*|#[^\n]*)(\n|$)", " ")
    return F.when(~odd, F.trim(F.regexp_replace(F.trim(F.regexp_replace(plain, r"\s+", " ")), r" ?;$", "")))


def _names(target: Column, table: str) -> Column:
    """Whether a target, quoted or not, with a database before it or not, is the table."""
    return target.rlike(rf"^(`?[a-z_][a-z0-9_$]*`?\.)?`?{table}`?$")


def _marks(text: Column) -> Column:
    """How many placeholders stand in a text, those in string literals not counted."""
    bare = F.regexp_replace(text, r"'[^']*'|\"[^\"]*\"", "")
    return F.length(bare) - F.length(F.replace(bare, F.lit("?"), F.lit("")))


def classify(log: DataFrame, table: str, key: list[str] | str, columns: list[str], sql: str = "sql", whole_table: bool = False) -> DataFrame:
    """log with kind: point_select, point_write, opaque_write or passthrough; columns: what a point_select asks for, in
    order; key_terms: for each key column, in declared order, the number as written or the position of its placeholder
    among the statement's; begins and ends: of transactions. `*` is answered only where the declared columns are the
    whole table."""
    key = [key] if isinstance(key, str) else key
    # Step by step, each a column of its own: an expression that is written out wherever it is used is run as often.
    out = log.withColumn("_q", normalised(F.col(sql)))
    part = lambda pattern, i: F.regexp_extract("_q", pattern, i)
    out = out.withColumns({"_asked": part(READ, 1), "_read": part(READ, 2), "_update": part(UPDATE, 1), "_delete": part(DELETE, 1), "_write": part(WRITE, 1)})
    out = out.withColumns({f"_{c}": _names(F.col(f"_{c}"), table) for c in ("read", "update", "delete", "write")})
    where = F.when(F.col("_read"), part(READ, 3)).when(F.col("_update"), part(UPDATE, 3)).when(F.col("_delete"), part(DELETE, 2))
    out = out.withColumns({"_terms": F.split(where, " and "), "_before": F.when(F.col("_read"), F.col("_asked")).when(F.col("_update"), part(UPDATE, 2)).otherwise("")})
    # Every key column once and nothing else, in any order.
    out = out.withColumns({"_named": F.transform("_terms", lambda t: F.regexp_extract(F.trim(t), TERM, 1)), "_values": F.transform("_terms", lambda t: F.regexp_extract(F.trim(t), TERM, 2))})
    whole_key = F.array_sort("_named") == F.array(*map(F.lit, sorted(key)))
    fits = F.forall("_values", lambda v: (v == "?") | (F.length(v) < 20) | (v.rlike("^[0-9]{20}$") & (v <= "18446744073709551615")))
    listed = F.transform(F.split("_asked", ","), lambda c: F.regexp_replace(F.trim(c), r"^`|`$", ""))
    out = out.withColumns({"_pointed": F.coalesce(whole_key & fits, F.lit(False)), "_listed": F.when(F.col("_read"), listed)})

    def term(name: str) -> Column:
        at = F.array_position("_named", name).cast("int")
        value = F.get("_values", at - 1)
        earlier = F.size(F.filter(F.slice("_values", 1, F.greatest(at - 1, F.lit(0))), lambda v: v == "?"))
        return F.struct(F.when(value != "?", value).alias("literal"), F.when(value == "?", _marks(F.col("_before")) + earlier).cast("int").alias("param"))

    star = F.col("_asked") == "*"
    asked = F.when(star, F.array(*map(F.lit, columns))).otherwise(F.col("_listed"))
    known = F.when(star, F.lit(whole_table)).otherwise(F.forall("_listed", lambda c: c.isin(columns)))
    out = out.withColumns({"_point_read": F.coalesce(F.col("_read") & known & F.col("_pointed"), F.lit(False)), "_point_write": F.coalesce((F.col("_update") | F.col("_delete")) & F.col("_pointed"), F.lit(False))})
    read, write = F.col("_point_read"), F.col("_point_write")
    kind = F.when(F.col("_q").isNull(), "passthrough").when(read, "point_select").when(write, "point_write").when(F.col("_write"), "opaque_write").otherwise("passthrough")
    told = {"kind": kind, "columns": F.when(read, asked), "key_terms": F.when(read | write, F.array(*map(term, key)))}
    told |= {name: F.coalesce(F.col("_q").isin(*words), F.lit(False)) for name, words in (("begins", ("begin", "start transaction")), ("ends", ("commit", "rollback")))}
    own = {*told, "_q", "_asked", "_read", "_update", "_delete", "_write", "_terms", "_before", "_named", "_values", "_pointed", "_listed", "_point_read", "_point_write"}
    return out.select(*(F.col(f"`{c}`") for c in log.columns if c not in own), *(c.alias(name) for name, c in told.items()))


def bound_keys(classified: DataFrame, table: str, args: str = "args") -> DataFrame:
    """classified statements with key_text, the row's key once the arguments (an array of texts) are bound: prepared
    statements are classified once and bound at each run. Null where an argument is missing or null."""
    value = lambda t: F.coalesce(t["literal"], F.get(F.col(args), t["param"]))
    parts = F.transform("key_terms", lambda t: escape_part(value(t)))
    known = F.forall("key_terms", lambda t: value(t).isNotNull())
    return classified.withColumn("key_text", F.when(known, F.concat_ws(":", F.lit(table), F.array_join(parts, ":"))))


def in_transactions(classified: DataFrame, connection: str = "connection", seq: str = "seq") -> DataFrame:
    """classified statements with in_tx: whether a transaction of their connection is open, by its statements before."""
    from pyspark.sql import Window

    before = Window.partitionBy(connection).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("begins"), True).when(F.col("ends"), False), ignorenulls=True).over(before)
    return classified.withColumn("in_tx", F.coalesce(last, F.lit(False)))


def routed(classified: DataFrame, in_tx: str = "in_tx") -> DataFrame:
    """served_by: the cache for point reads outside transactions, else the origin; invalidates: whether a tombstone
    follows (for opaque writes of the table it can't be told which keys, so it is refused)."""
    cached = (F.col("kind") == "point_select") & ~F.col(in_tx)
    return classified.withColumn("served_by", F.when(F.col("kind") == "opaque_write", "refused").when(cached, "cache").otherwise("origin")).withColumn("invalidates", F.col("kind") == "point_write")


def typed(value: Column, kind: str) -> Column:
    """A cached text as a result of a declared type: struct(number, bytes, served). Integers are read, other types are
    bytes; an integer that can't be read isn't served."""
    if not kind.startswith("uint"):
        return F.struct(F.lit(None).cast("decimal(20,0)").alias("number"), value.cast("binary").alias("bytes"), value.isNotNull().alias("served"))
    number = canonical_uint(value, int(kind[4:]))
    return F.struct(number.alias("number"), F.lit(None).cast("binary").alias("bytes"), number.isNotNull().alias("served"))
