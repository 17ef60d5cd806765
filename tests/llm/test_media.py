"""Progressive JPEG round trips, against another decoder, and the media operators."""

import hashlib
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import jpeg, media
from tidemark.llm.common import text_bytes


def payloads(seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for n in (1, 2, 6, 7, 50, 300):
        a = rng.laplace(0, 6, (n, 64)).round().clip(-128, 127).astype(np.int16)
        a[rng.random((n, 64)) < 0.3] = 0
        out.append(a)
    sparse = np.zeros((5, 64), np.int16)
    sparse[2, 63], sparse[3, 40], sparse[1, 3], sparse[0, 0] = 5, -1, 1, -128
    wide = rng.integers(-128, 129, (40, 64)).astype(np.int16)
    return [*out, np.zeros((3, 64), np.int16), sparse, wide]


def test_round_trip():
    own = payloads()
    files = jpeg.encode(own, [len(p).to_bytes(8, "big") * 2 for p in own])
    images, coefs = jpeg.coefficients(files)
    for p, image in zip(own, images):
        y, cb, cr = image.parts
        w, h = jpeg.geometry(len(p))
        six = np.zeros((w * h, 6, 64), np.int16)
        six[:, :4] = coefs[y.row : y.row + w * h * 4].reshape(h, 2, w, 2, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 4, 64)
        six[:, 4], six[:, 5] = coefs[cb.row : cb.row + w * h], coefs[cr.row : cr.row + w * h]
        assert np.array_equal(six.reshape(-1, 64)[: len(p)], p)


def test_alone_and_together():
    """A file's pixels don't depend on the batch it is read in."""
    files = jpeg.encode(payloads(), [b""] * 9)
    together = jpeg.rgb(*jpeg.coefficients(files))
    for f, t in zip(files, together):
        assert np.array_equal(jpeg.rgb(*jpeg.coefficients([f]))[0], t)


def test_other_decoder(spark, tmp_path):
    """The JVM's own decoder gives the same luma (it interpolates chroma, so chroma is left empty)."""
    own = payloads(1)[5]
    own = np.concatenate([own, own])[: len(own) // 6 * 6]
    own.reshape(-1, 6, 64)[:, 4:] = 0
    data = jpeg.encode([own], [b""])[0]
    path = os.path.join(tmp_path, "a.jpg")
    open(path, "wb").write(data)
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.File(path))
    ours = jpeg.rgb(*jpeg.coefficients([data]))[0]
    assert (image.getHeight(), image.getWidth()) == ours.shape[:2]
    rng = np.random.default_rng(0)
    for y, x in zip(rng.integers(0, ours.shape[0], 200), rng.integers(0, ours.shape[1], 200)):
        p = image.getRGB(int(x), int(y))
        theirs = [(p >> 16) & 255, (p >> 8) & 255, p & 255]
        assert np.abs(np.array(theirs) - ours[y, x]).max() <= 2


@pytest.mark.parametrize("data", [b"", b"\xff\xd8\xff\xd9x"[:1], b"GIF89a"])
def test_other_files(data):
    with pytest.raises((ValueError, IndexError)):
        jpeg.parse(data)


def test_payloads(spark, odd, documents):
    docs = odd.select("doc_id", "text").unionByName(documents.select("doc_id", "text")).withColumn("k", F.monotonically_increasing_id()).cache()
    rows = docs.select("k", text_bytes("text").alias("b")).select("k", media.padded(F.col("b")).alias("p"), F.octet_length("b").alias("n"))
    files = media.store_payloads(rows, "p", ["k"], "n").cache()
    got = {r.k: r for r in media.read_payloads(files, ["k"]).collect()}
    seen = {}
    for r in docs.collect():
        b = (r.text or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert bytes(got[r.k].payload) == p and got[r.k].n_bytes == len(b)
        assert seen.setdefault(r.text or "", got[r.k].feature) == got[r.k].feature
    pixels = media.decode_media(files.limit(5), ["k"]).collect()
    assert all(len(r.rgb) == r.height * r.width * 3 for r in pixels)
    assert media.decode_media(files.withColumn("media", F.lit(None).cast("binary")).limit(2), ["k"]).first().rgb is None


def test_query(spark):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op2_media"](spark, sf).collect():
        b = texts[r.doc_id].encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
