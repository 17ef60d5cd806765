"""Keys, clocks, sessions, rows, hashes: golden cases and properties."""

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import columns as C
from tidemark.functions import hashing as H
from tidemark.functions.schema import ColumnSpec, TableSpec, decode_row, encode_row


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_hlc_pack(spark):
    r = one(spark, C.hlc(F.lit(1700000000123), F.lit(42)).alias("v")).v
    r = one(spark, C.hlc_ms(F.lit(r)), C.hlc_logical(F.lit(r)))
    assert tuple(r) == (1700000000123, 42)


@pytest.mark.parametrize("parts,key", [(["a:b"], "users:a%3Ab"), (["7", "alice"], "users:7:alice"), ([""], "users:"), (["100%"], "users:100%25"), (["a\nb"], "users:a%0Ab"), (["🎯"], "users:🎯")])
def test_keys_round_trip(spark, parts, key):
    rows = spark.createDataFrame([tuple(parts)], ", ".join(f"p{i} string" for i in range(len(parts))))
    k = C.format_key("users", *(F.col(c) for c in rows.columns))
    r = rows.select(k.alias("k"), C.parse_key(k).alias("p")).first()
    assert r.k == key and r.p.table == "users" and r.p.parts == parts


@pytest.mark.parametrize("key", ["", "entities", ":123", "1entities:2", "entities:%", "entities:%zz", "entities:%4", "ent ities:1"])
def test_bad_keys(spark, key):
    r = one(spark, C.valid_key(F.lit(key)).alias("v"), C.parse_key(F.lit(key)).alias("p"))
    assert not r.v and r.p is None


def test_keys_are_one_to_one(spark):
    pairs = [("a", "b:c"), ("a:b", "c"), ("a%3Ab", "c"), ("a", "b%3Ac"), ("", "a"), ("a", ""), ("%", ":"), (":", "%")]
    rows = spark.createDataFrame(pairs, "x string, y string")
    assert rows.select(C.format_key("t", F.col("x"), F.col("y")).alias("k")).distinct().count() == len(pairs)


@pytest.mark.parametrize("text,value", [("0", 0), ("007", None), ("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), ("-1", None), ("x", None)])
def test_canonical_uint(spark, text, value):
    got = one(spark, C.canonical_uint(F.lit(text)).alias("v")).v
    assert (None if got is None else int(got)) == value


def test_sessions(spark):
    m = F.create_map(F.lit("b"), F.lit(2), F.lit("a"), F.lit(1))
    assert one(spark, C.encode_session(m).alias("s")).s == "a:1,b:2"
    assert one(spark, C.decode_session(F.lit("a:1,b:2")).alias("s")).s == {"a": 1, "b": 2}
    assert one(spark, C.decode_session(F.lit("")).alias("s")).s == {}
    assert one(spark, C.merge_sessions(m, C.decode_session(F.lit("a:9,c:3"))).alias("s")).s == {"a": 9, "b": 2, "c": 3}


NOW, S = 1700000000000, 1000


@pytest.mark.parametrize(
    "level,fv_ms,watermark_ms,bound,skew,ok",
    [
        ("STRONG", NOW, None, 0, 250, False), ("EVENTUAL", NOW - 86400 * S, NOW, 0, 250, True),
        ("SESSION", NOW - S, NOW, 0, 250, False), ("SESSION", NOW, NOW, 0, 250, True), ("SESSION", NOW - S, None, 0, 250, True),
        ("BOUNDED", NOW - 10 * S, None, 5 * S, 250, False), ("BOUNDED", NOW - S, None, 5 * S, 250, True),
        ("BOUNDED", NOW - 4900, None, 5 * S, 250, False), ("BOUNDED", NOW - 4900, None, 5 * S, 0, True), ("BOUNDED", NOW - S, NOW, 3600 * S, 250, False),
    ],
)
def test_accepts(spark, level, fv_ms, watermark_ms, bound, skew, ok):
    w = F.lit(None).cast("long") if watermark_ms is None else F.lit(watermark_ms << 16)
    assert one(spark, C.accepts(F.lit(level), F.lit(fv_ms << 16), w, F.lit(NOW), F.lit(bound), skew).alias("x")).x is ok


@pytest.mark.parametrize("level,bound,ok", [("session", None, "SESSION"), (" Bounded ", 5, "BOUNDED"), ("", None, "SESSION"), ("BOUNDED", None, None), ("STRONG", 5, None), ("other", None, None)])
def test_requirements(level, bound, ok):
    if ok:
        assert C.check_requirement(level, bound) == ok
    else:
        with pytest.raises(ValueError):
            C.check_requirement(level, bound)


@pytest.mark.parametrize("failures,total,shed", [(2, 10, 0), (2, 100, 0), (20, 100, 0.15), (40, 100, 0.35), (60, 100, 0.55), (80, 100, 0.75), (100, 100, 0.95)])
def test_shed(spark, failures, total, shed):
    assert abs(one(spark, C.shed_probability(F.lit(failures), F.lit(total)).alias("x")).x - shed) < 0.01


@pytest.mark.parametrize("n,v,nines", [(1000, 1, 3.0), (100, 1, 2.0), (3, 0, 0.0), (3000, 0, 3.0)])
def test_nines(spark, n, v, nines):
    assert abs(one(spark, C.nines(F.lit(n), F.lit(v)).alias("x")).x - nines) < 1e-9


def test_ring():
    assert [f"{h:x}" for h in H.ring_hash([b"entities:1", b"entities:42"]).tolist()] == ["4c4ec3554a1a209e", "1ba7ba951857b3ce"]
    nodes = ["shard0", "shard1", "shard2"]
    assert H.locate([f"entities:{i}".encode() for i in range(1, 6)], nodes) == ["shard1", "shard2", "shard0", "shard1", "shard1"]
    keys = [f"entities:{i}".encode() for i in range(1, 30001)]
    old, new = H.locate(keys, nodes), H.locate(keys, [*nodes, "shard3"])
    assert sorted(map(old.count, nodes)) == [9897, 9928, 10175]
    moved = [b for a, b in zip(old, new) if a != b]
    assert 0.2 < len(moved) / len(keys) < 0.3 and set(moved) == {"shard3"}
    assert H.locate(keys[:100], [*nodes, "shard0"]) == old[:100]


@given(st.lists(st.one_of(st.none(), st.binary(max_size=300)), min_size=1, max_size=20))
def test_rows_round_trip(values):
    assert decode_row(encode_row(values), len(values)) == values


@given(st.binary(max_size=40))
def test_garbage_rows(data):
    try:
        values = decode_row(data, 3)
    except ValueError:
        return
    assert len(values) == 3


def test_garbage_row():
    with pytest.raises(ValueError):
        decode_row(b"\x01\xff", 9)


def spec(**change):
    own = {"name": "t", "columns": (ColumnSpec("id", "uint64"), ColumnSpec("name", "string", True), ColumnSpec("version", "uint64")), "key": ("id",), "version": "version"}
    return TableSpec(**{**own, **change})


def test_specs():
    t = spec()
    assert len(t.fingerprint) == 16 and t.missing_from(t.struct()) == []
    assert spec(columns=(*t.columns, ColumnSpec("x", "int64"))).fingerprint != t.fingerprint


@pytest.mark.parametrize(
    "change",
    [
        {"name": "1t"}, {"columns": ()}, {"key": ()}, {"key": ("name",)}, {"version": "name"}, {"version": "none"},
        {"columns": (ColumnSpec("id", "double"), ColumnSpec("version", "uint64"))},
        {"columns": (ColumnSpec("id", "string"), ColumnSpec("version", "uint64"))},
        {"columns": (ColumnSpec("id", "string", False, "utf8mb4_general_ci"), ColumnSpec("version", "uint64"))},
    ],
)
def test_bad_specs(change):
    with pytest.raises(ValueError):
        spec(**change)


@pytest.mark.parametrize(
    "sql,kind,key,args",
    [
        ("select payload from gadgets where shop = 3 and id = ?", "point_select", "gadgets:9:3", ["9"]),
        ("update gadgets set payload = ?, status = ~?~ where id = ? and shop = ?", "point_write", "gadgets:8:9", ["7", "8", "9"]),
        ("select * from gadgets where id = 1 and shop = 2", "point_select", "gadgets:1:2", []),
        ("select payload from gadgets where id = ? and shop = ?", "point_select", None, ["1", None]),
        ("select payload from gadgets where id = 1", "passthrough", None, []),
        ("delete from gadgets where id = 1 and id = 2", "opaque_write", None, []),
        ("select payload from gadgets where id = 18446744073709551616 and shop = 1", "passthrough", None, []),
        ("", "passthrough", None, []),
        (None, "passthrough", None, []),
    ],
)
def test_composite_keys(spark, sql, kind, key, args):
    from tidemark.operators import statements

    rows = spark.createDataFrame([(sql and sql.replace("~", "'"), args)], "sql string, args array<string>")
    out = statements.classify(rows, "gadgets", ["id", "shop"], ["id", "shop", "payload", "status"], whole_table=True)
    r = statements.bound_keys(out, "gadgets").first()
    assert (r.kind, r.key_text) == (kind, key)


@pytest.mark.parametrize("text,value", [("18446744073709551615", 2**64 - 1), ("18446744073709551616", None), ("12345678901234567890123", None), ("7", 7), ("-1", None)])
def test_json_version_range(spark, text, value):
    from tidemark.sources.text import json_version

    got = one(spark, json_version(F.lit('{"v": ' + text + ', "a": {"b": 3}, "a.b": 5}'), "v").alias("v"), json_version(F.lit('{"a": {"b": 3}}'), "a.b").alias("p"))
    assert (None if got.v is None else int(got.v)) == value and got.p is None


def test_key_files(spark, tmp_path):
    from tidemark.sources import text

    (tmp_path / "keys").write_text("# list\n\n users:1 \nusers:2\n")
    (tmp_path / "none").write_text("# list\n")
    assert [r.key for r in text.key_file(spark, str(tmp_path / "keys")).orderBy("line").collect()] == ["users:1", "users:2"]
    with pytest.raises(ValueError):
        text.key_file(spark, str(tmp_path / "none"))
    text.write_reports(spark.createDataFrame([("a", 1.5)], "phase string, p99_us double"), str(tmp_path / "reports"))
    assert text.reports(spark, str(tmp_path / "reports"), "phase string, p99_us double").first().p99_us == 1.5


def test_workload_definitions(spark):
    from tidemark.sources.text import workload_definitions

    body = "# the control\nid: W1\nname: Uniform control\ndistribution: uniform\nread_fraction: 0.95  # mostly reads\nrows: 10000\nrate: 2000\nworkers: 64\nwarmup: 60s\nmeasure: 300s\nseed: 42"
    lines = [("w1", x) for x in body.split("\n")] + [("bad", x) for x in body.replace("uniform", "odd").replace("10000", "many").split("\n")]
    got = {r.file: r for r in workload_definitions(spark.createDataFrame(lines, "file string, value string")).collect()}
    w = got["w1"]
    assert (w.id, w.distribution, w.read_fraction, w.rows, w.rate, w.workers, w.warmup_s, w.measure_s, w.seed, w.ready) == ("W1", "uniform", 0.95, 10_000, 2000.0, 64, 60, 300, 42, True)
    assert got["bad"].rows is None and not got["bad"].ready


def test_ranks(spark):
    """Exact order statistics per group, ties and nulls among them."""
    import random

    from tidemark.operators.ranks import at_ranks

    r = random.Random(4)
    rows = [(r.choice(["a", "b", None]), r.choice([None, 1.0, 2.0, r.random() * 1e6])) for _ in range(500)]
    got = {g.k: g for g in at_ranks(spark.createDataFrame(rows, "k string, x double"), "x", ["k"], {"p": F.ceil(F.col("n") * 0.9), "m": F.floor(F.col("n") / 2) + 1}).collect()}
    for k in ("a", "b", None):
        xs = sorted(x for g, x in rows if g == k and x is not None)
        assert got[k].m == xs[len(xs) // 2] and got[k].p == xs[-(-len(xs) * 9 // 10) - 1]


def test_statements_are_normalised_once(spark):
    """The patterns run on a column of their own; written out wherever they are used they would run hundreds of times a row."""
    from tidemark.operators import statements

    log = spark.createDataFrame([(1, "SELECT b FROM t WHERE a = 1 AND c = ?", ["7"]), (2, None, None)], "seq long, sql string, args array<string>")
    out = statements.bound_keys(statements.classify(log, "t", ["a", "c"], ["a", "b", "c"]), "t")
    assert out.columns == ["seq", "sql", "args", "kind", "columns", "key_terms", "begins", "ends", "key_text"]
    assert [(r.kind, r.columns, r.key_text) for r in out.orderBy("seq").collect()] == [("point_select", ["b"], "t:1:7"), ("passthrough", None, None)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("lower(") <= 20
