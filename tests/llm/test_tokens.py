"""Token files and packing against the tokenizers library, document by document."""

import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.conftest import ODD
from tidemark.llm.packing import Packer, pack
from tidemark.llm.token_files import ids_of, read_token_files, sequence_at, write_token_files
from tidemark.llm.tokenizer import Encoder, vocabulary


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_latin_pattern():
    """The fast pattern cuts as the general one, around every character of Latin-1."""
    e = Encoder(vocabulary())
    for c in map(chr, range(256)):
        for text in (c, f"a{c}b", f" {c} ", f"{c}{c}1", f"a {c}\n{c}  b", f"'{c}s", f"x{c}'ll {c}9"):
            assert e.find_latin(text) == e.find_any(text), repr(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder(plain):
    texts = [*ODD, "  a  b\n\n c\t", "it's they'll 12 3½  x", "\x00\x01 a", "a­b ﻿", " \r\n ", "​　zz\x85y\x1cq", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext"]
    for text, ids in zip(texts, Encoder(vocabulary()).encode(texts, 2)):
        assert ids.tolist() == [*plain(text), 2]


@pytest.mark.parametrize("size", [500_000, 3000])
def test_token_files(documents, odd, plain, size):
    docs = documents.select("doc_id", "text").unionByName(odd.select((odd.doc_id + 1000).alias("doc_id"), "text"))
    shards = write_token_files(docs, file_tokens=size, sequence=128)
    got = sorted(read_token_files(shards).collect(), key=lambda r: r.start)
    want = defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append([*plain(r.text), 2])
    start, last = 0, None
    for r in got:
        assert r.start == start and (last is None or (r.doc_id is not None and r.doc_id >= last))
        assert any(len(w) == r.n_tokens and crc(w) == r.ids_crc32 for w in want[r.doc_id])
        start, last = start + r.n_tokens, r.doc_id
    assert len(got) == docs.count()
    data = bytes(shards.orderBy("n_tokens").collect()[-1].tokens)
    ids, n = ids_of(data)
    assert len(ids) % 128 == 0 and n <= len(ids) < n + 128
    inside = np.frombuffer(data, np.uint8)
    for i in {0, len(ids) // 256, len(ids) // 128 - 1}:
        own, mask = sequence_at(data, i)
        assert own.tolist() == ids[i * 128 : i * 128 + 128].tolist() and len(mask) == 128
        assert np.shares_memory(own, inside) and mask.true_count == min(128, n - i * 128)


def test_empty(empty):
    assert read_token_files(write_token_files(empty)).count() == 0
    assert pack(empty).count() == 0


def test_packing(documents, odd, plain):
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id is not null").select((odd.doc_id + 1000).alias("doc_id"), "text").dropDuplicates(["doc_id"]))
    pieces = pack(docs).collect()
    texts = {r.doc_id: [*plain(r.text), 1] for r in docs.collect()}
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        of_doc[p.doc_id].append(p)
        of_sequence[p.sequence_id].append(p)
        assert p.ids_crc32 == crc(texts[p.doc_id][p.start : p.start + p.length]) and p.doc_tokens == len(texts[p.doc_id]) and p.length > 0
    for d, ps in of_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at
            at += p.length
        assert at == len(texts[d])
    assert set(of_doc) == set(texts)
    padding = 0
    for ps in of_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding == 0
    groups, last = defaultdict(int), {}
    for p in pieces:
        groups[p.tier, p.step_group] += p.length
        last[p.tier] = max(last.get(p.tier, 0), p.step_group)
    # All groups of a tier are equal but for its last; closing windows below the smallest tier may lack some tokens.
    for (tier, group), n in groups.items():
        assert n <= 16 * 2048 and (group == last[tier] or n == 16 * 2048 or (tier == 256 and n > 15 * 2048))


@pytest.mark.parametrize("seed", [1, 2])
def test_gaps(seed):
    """Long windows take whole pieces of shorter tiers into their gaps, and cut one document at most."""
    rng = np.random.default_rng(seed)
    packer = Packer((256, 512, 1024, 2048), 0)
    sizes = np.minimum(rng.lognormal(5.5, 1.1, 3000).astype(int) + 1, 9000)
    pieces = [p for d, n in enumerate(sizes.tolist()) for p in packer.take(d, np.arange(n, dtype=np.uint32))]
    full = {p[5] for p in pieces}
    pieces += packer.close()
    of = defaultdict(list)
    for p in pieces:
        of[p[5]].append(p)
    assert sum(p[2] for p in pieces) == sizes.sum()
    long = [of[s] for s in full if of[s][0][7] == 2048]
    mixed = [w for w in long if any(p[4] <= 1024 for p in w)]
    assert len(mixed) > len(long) / 10  # documents of shorter tiers in long windows
    ends_inside = lambda p: p[1] + p[2] < p[4]
    assert all(sum(map(ends_inside, of[s])) <= 1 for s in full)
    assert all(sum(p[2] for p in of[s]) == of[s][0][7] for s in full)
    whole = sum(p[2] == p[4] for p in pieces if p[4] <= 2048) / sum(p[4] <= 2048 and p[1] == 0 for p in pieces)
    assert whole > 0.7


def test_step_groups_over_partitions(spark, documents):
    """Groups are equal over all partitions, however few tokens each has."""
    pieces = pack(documents.repartition(23), step_tokens=4096).collect()
    groups, last = defaultdict(int), {}
    for p in pieces:
        groups[p.tier, p.step_group] += p.length
        last[p.tier] = max(last.get(p.tier, 0), p.step_group)
    assert len({p.sequence_id >> 36 for p in pieces}) == 23
    assert all(n == 4096 for (t, g), n in groups.items() if t > 256 and g < last[t]) and sum(n == 4096 for n in groups.values()) > 10
