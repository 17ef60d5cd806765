"""WARC bundles: round trips, seeks, revisits, SQL."""

import hashlib

from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidemark.llm import warc
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def pages(spark):
    big = "<html>" + "é" * 600 + "</html>"
    rows = [(1, "http://a/1", big), (2, "http://a/2", big), (3, None, big), (4, "http://a/4", "small"), (5, "http://a/5", "small"), (6, "u\r\nX: 1", None), (7, "", ""), (None, "http://n", big), (None, "http://n", "x" * 2000), (9, "http://a/9", "y" * 300_000), (3, None, big)]
    return spark.createDataFrame([(*r, "c", b"d") for r in rows], "page_id long, url string, html string, digest string, payload binary")


def test_round_trip(spark):
    p = pages(spark)
    bundles = warc.write_warc(warc.plan_records(p), frame_bytes=4000, bundle_bytes=9000)
    got = warc.read_warc(bundles).collect()
    assert len(got) == p.count()
    kinds = {(warc.page_of(r.record_id), r.record_type, warc.page_of(r.refers_to)) for r in got}
    assert kinds == {(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (None, "revisit", 3), (None, "response", None), (9, "response", None)}
    html = {}
    for r in p.collect():
        html.setdefault(r.page_id, set()).add((r.html or "").encode())
    for r in got:
        own = html[warc.page_of(r.record_id)]
        assert r.payload is None or bytes(r.payload) in own
        assert (r.payload_bytes, r.payload_digest) in {(len(b), hashlib.sha1(b).hexdigest()) for b in own}


def test_seek(spark):
    bundles = warc.write_warc(warc.plan_records(pages(spark)), frame_bytes=1500).cache()
    got = warc.read_records(bundles, [warc.record_id(4), warc.record_id(9)]).collect()
    assert {(r.record_id, bytes(r.payload)) for r in got} == {(warc.record_id(4), b"small"), (warc.record_id(9), b"y" * 300_000)}
    data = bytes(bundles.first().data)
    spans = warc.frame_spans(data)
    assert all(len(warc.read_frame(data, s)) == s[2] for s in spans)
    import zstandard

    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert len(whole) == sum(s[2] for s in spans)


def test_empty(spark):
    assert warc.read_warc(warc.write_warc(warc.plan_records(pages(spark).where("false")))).count() == 0


def test_sql(spark):
    assert same(QUERIES["op3_warc"](spark, SF), connect(SF), SQL["op3_warc"]) > 0


def test_one_response_each(spark):
    out = warc.plan_records(spark.read.parquet(f"{SF}/pages.parquet"))
    big = out.where(F.octet_length("payload") >= 1000)
    assert big.where("record_type = 'response'").count() == big.select("payload").distinct().count()
