"""SimHash, near-duplicates and repeated passages against brute force."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from tidemark.llm import bitslice, simhash
from tidemark.llm.components import components
from tidemark.llm.simhash import band_plan, block_tables, blocks_for, groups, near_duplicates, one_of_each
from tidemark.llm.substring_dedup import remove_repeats, units_of


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []


def fingerprint(text):
    h = [xxh64_intdigest(s, 42) for s in shingles(text, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("radius,width", [(4, 8), (0, 8), (20, 16), (77, 48)])
def test_bit_planes(radius, width):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 256, (40, width), np.uint8)
    fps = np.repeat(base, 5, axis=0)
    for row in fps:
        for b in rng.integers(0, width * 8, rng.integers(0, 2 * radius + 2)):
            row[b // 8] ^= 1 << (b % 8)
    d = np.bitwise_count(fps[:, None] ^ fps[None]).sum(axis=2)
    want = {(i, j) for i, j in np.argwhere(d <= radius) if i < j}
    got = {(min(q, r), max(q, r)) for qs, rs in bitslice.close_to(fps, fps, radius, 16) for q, r in zip(qs.tolist(), rs.tolist()) if q != r}
    assert got == want
    run = np.repeat(np.arange(5), 40)
    got = {(i, j) for a, b in bitslice.close_in_runs(fps, run, radius, 40) for i, j in zip(a.tolist(), b.tolist())}
    assert got == {(i, j) for i, j in want if run[i] == run[j]}


def test_forest_is_shortest():
    rng = np.random.default_rng(5)
    i, j = rng.integers(0, 60, (2, 400))
    d = rng.integers(0, 30, 400)
    kept = bitslice.shortest_forest(60, i, j, d)
    root, total = list(range(60)), 0

    def find(x):
        return x if root[x] == x else find(root[x])

    for k in np.argsort(d, kind="stable"):
        if find(i[k]) != find(j[k]):
            root[find(i[k])] = find(j[k])
            total += d[k]
    assert d[kept].sum() == total


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    want = linked(600, pairs)
    got = components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()
    assert len(got) == len({x for p in pairs if p[0] != p[1] for x in p})
    assert all(want[r.node] == r.component for r in got)


def near_copies(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 7)))
    out = []
    for _ in range(12):
        base = [word() for _ in range(r.randrange(60, 400))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 9)):
                copy[r.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out


def test_groups(spark, documents, odd):
    texts = [r.text for r in documents.collect()] + near_copies() + ["", None, "  ", "a b", "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    fps = [fingerprint(t) for t in texts]
    want = linked(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 4])
    got = {r.doc_id: r for r in groups(docs).collect()}
    assert [got[i].fingerprint for i in range(len(fps))] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i in range(len(fps))] == want
    assert groups(odd).count() == odd.count()


def test_crowded_cells(spark, monkeypatch):
    """Keys with more rows than a cell holds are compared in pairs of groups, and nothing is lost."""
    from tidemark.llm import simhash

    r = random.Random(9)
    base = [r.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ sum(1 << x for x in r.sample(range(64), r.randrange(0, 5))) for b in base for _ in range(120)})
    rows = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v, bytearray(v.to_bytes(8, "big"))) for v in values], "node long, fp binary")
    found = simhash.links(rows, 4, block_tables(), cell=20).collect()
    at = {(v - (1 << 64) if v >> 63 else v): i for i, v in enumerate(values)}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 4]
    assert all(bin(values[at[f.a]] ^ values[at[f.b]]).count("1") == f.d <= 4 for f in found)
    assert linked(len(values), [(at[f.a], at[f.b]) for f in found]) == linked(len(values), pairs)


def test_near_duplicates(spark, odd):
    texts = near_copies(8)
    sets = [set(shingles(t, 5)) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = linked(len(texts), pairs)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    names = {}
    assert all(names.setdefault(got[i].group, want[i]) == want[i] for i in range(len(texts))) and len(names) == len(set(want))
    assert sorted(i for i in got if got[i].keep) == sorted(set(want))
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    assert len(rows) == 6 and sorted(r.text or "" for r in rows if r.doc_id is None) == ["Text without an id, told apart by its words alone."]


@pytest.mark.parametrize("words", [8, 9, 12, 14, 24, 34, 54, 104])
def test_near_duplicates_recall(spark, words):
    """Pairs at a similarity of exactly or nearly 0.8, by length: at least 0.97 of them are linked, and no pair below."""
    r = random.Random(words)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    rows, want = [], 0
    for i in range(250):
        n = words - 4  # shingles of the longer text; the shorter one lacks words at its end
        base = [word() for _ in range(words)]
        cut = n - int(np.ceil(0.8 * n))
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[: words - cut])), (10 * i + 2, " ".join([word(), *base[1 : words - cut]]))]
    sets = {d: set(shingles(t, 5)) for d, t in rows}
    got = {g.doc_id: g.group for g in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    linked_pairs = hits = 0
    for i in range(250):
        similar = lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
        assert similar(10 * i, 10 * i + 1)
        hits += got[10 * i] == got[10 * i + 1]
        if not similar(10 * i, 10 * i + 2) and not similar(10 * i + 1, 10 * i + 2):
            linked_pairs += got[10 * i + 2] in (got[10 * i], got[10 * i + 1])
    assert hits >= 0.97 * 250 and linked_pairs == 0


def test_keys_grow():
    """Keys get wider with the number of rows, so that what shares one doesn't grow; op5's tables stay exact."""
    assert blocks_for(10**5) == 6 and blocks_for(10**9) == 7 and blocks_for(10**11) == 8
    for blocks in (6, 7, 8):
        tables = block_tables(64, blocks, blocks - 4)
        r = random.Random(blocks)
        for _ in range(300):
            flips = set(r.sample(range(64), 4))
            assert any(not flips & set(t) for t in tables)
    for n in (10**4, 10**6, 10**9, 10**11):
        band, words, mean, spread = band_plan(n, 0.8)
        assert n / 2**band <= 512 and 64 * words // band * band <= 64 * words and 1 - (1 - (1 - mean / (64 * words)) ** band) ** (64 * words // band) > 0.99


def test_clashing_columns(spark):
    """Columns named like the operators' own come back as they were."""
    names = ["_version", "_spans", "_span_id", "_span_version", "_found", "version", "found", "_hash", "hash", "row", "kept_id", "_kept_id", "_kept_hash", "kept_hash", "node", "id", "digest", "pos"]
    rows = spark.createDataFrame([(i, "a line of a text\nand more of it", *range(len(names))) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{c} long" for c in names))
    for out in (one_of_each(rows), remove_repeats(rows)):
        got = out.collect()
        assert out.columns[: len(rows.columns)] == rows.columns and len(set(out.columns)) == len(out.columns)
        assert got and all([r[c] for c in names] == list(range(len(names))) for r in got)
    with pytest.raises(ValueError):
        remove_repeats(rows.withColumnRenamed("_spans", "removed_spans"))


def test_empty(empty):
    assert groups(empty).count() == one_of_each(empty).count() == remove_repeats(empty).count() == 0


def sentence(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n)).capitalize() + "."


def test_units_cover():
    r = random.Random(2)
    text = "\n".join(sentence(r, r.randrange(1, 60)) for _ in range(50)) + "\n\n  tail"
    starts, stops, sizes, _ = units_of(text)
    assert starts[0] == 0 and stops[-1] == len(text) and stops[:-1] == starts[1:]
    assert sum(sizes) == len(text.split()) and len(set(units_of("İ b. İ b.")[3])) == 1


def test_passages(spark, odd):
    r = random.Random(4)
    passage = " ".join(sentence(r, 15) for _ in range(4))
    clean = [" ".join(sentence(r, r.randrange(4, 12)) for _ in range(20)) for _ in range(30)]
    short = sentence(r, 9)
    docs = []
    for i, text in enumerate(clean):
        words = text.split(" ")
        at = r.randrange(5, len(words) - 5)
        middle = [passage] if i % 3 == 0 else [short] if i % 3 == 1 else []
        docs.append(" ".join(words[:at] + middle + words[at:]))
    docs += [clean[2], clean[2]]
    rows = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in remove_repeats(rows).collect()}
    assert sum(passage in g.text for g in got.values()) == 1 and passage in got[0].text
    for i, text in enumerate(docs):
        spans = got[i].removed_spans
        assert got[i].text == "".join(text[a:b] for a, b in zip([0, *(s.stop for s in spans)], [*(s.start for s in spans), len(text)]))
        if i < 30 and i % 3:
            assert not spans
    assert got[30].text == got[31].text == ""
    out = {(r.doc_id, r.text) for r in remove_repeats(odd).select("doc_id", "text").collect()}
    assert (0, None) in out and (1, "") in out and remove_repeats(odd).columns == [*odd.columns, "removed_spans"]


@pytest.mark.parametrize("lang", ["en", "fr", "de", "es"])
def test_passages_from_mid_sentence(spark, documents, lang):
    """Passages of 30 and of 51 to 80 words, cut from and put at any word, go to the last word; shorter ones stay."""
    r = random.Random(lang)
    words = [w for d in documents.where(f"lang = '{lang}'").collect() for w in d.text.split()]
    rows, want = [], {}
    for i in range(60):
        a, b = r.choices(words, k=300), r.choices(words, k=300)
        n = 29 if i % 6 == 0 else 30 if i % 6 == 1 else r.randrange(51, 81)
        x, y = r.randrange(1, 300 - n), r.randrange(1, 300)
        while a[x - 1].lower() == b[y - 1].lower() or a[x + n].lower() == b[y].lower():
            y = r.randrange(1, 300)
        rows += [(2 * i, " ".join(a)), (2 * i + 1, " ".join(b[:y] + a[x : x + n] + b[y:]))]
        want[2 * i] = " ".join(a)
        want[2 * i + 1] = rows[-1][1] if n < 30 else " ".join(b)
    got = {g.doc_id: g.text for g in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_against_brute_force(spark, documents, odd):
    """Every line and every 30 words of whole tables, null and repeated ids among them, looked up one by one."""
    from pyspark.sql import functions as F

    docs = documents.select("doc_id", "text").unionByName(odd.where("n_chars is null or n_chars <> 7").select("doc_id", "text"))
    docs = docs.unionByName(documents.where("doc_id % 9 = 0").select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("own words first\n"), "text").alias("text")))
    docs = docs.unionByName(documents.where("doc_id % 11 = 0").select(F.lit(5).cast("long").alias("doc_id"), F.concat("text", F.lit(" and last")).alias("text"))).repartition(5)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    rows = remove_repeats(docs.withColumn("was", F.col("text"))).withColumn("version", F.xxhash64("was").bitwiseAND(0x7FFFFFFF)).collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.version))
    lines, seen = {}, {16: {}, 30: {}}
    must = missed = removed = 0
    for rank, r in enumerate({(r.doc_id, r.was): r for r in rows}.values()):
        words = (r.was or "").lower().split()
        starts = [m.start() for m in re.finditer(r"\S+", r.was or "")]
        gone = [any(s.start <= x < s.stop for s in r.removed_spans) for x in starts]
        covered = {k: [False] * len(words) for k in seen}
        in_line = [False] * len(words)
        at = 0
        for line in (r.was or "").split("\n"):
            n = len(line.split())
            if n >= 3:
                key = tuple(words[at : at + n])
                if key in lines:
                    in_line[at : at + n] = [True] * n
                lines.setdefault(key, rank)
            at += n
        for k, known in seen.items():
            for i in range(len(words) - k + 1):
                g = tuple(words[i : i + k])
                if g in known:
                    covered[k][i : i + k] = [True] * k
                known.setdefault(g, rank)
        assert all(g for g, x in zip(gone, in_line) if x), r.doc_id  # repeated lines go
        assert not [i for i, g in enumerate(gone) if g and not in_line[i] and not covered[16][i]], r.doc_id  # nothing else goes
        must += sum(covered[30])
        missed += sum(c and not g for c, g in zip(covered[30], gone))
        removed += sum(gone)
        assert (r.was is None) == (r.text is None) and (r.was is None or r.text == "".join(r.was[a:b] for a, b in zip([0, *(s.stop for s in r.removed_spans)], [*(s.start for s in r.removed_spans), len(r.was)])))
    assert must > 5000 and removed > must and missed < 0.01 * must


@pytest.mark.parametrize("doc_id", [None, 7])
def test_passages_without_own_id(spark, doc_id):
    """A passage that only rows of one id, or without id, share stays in one of them, once."""
    r = random.Random(6)
    passage = sentence(r, 60)
    rows = [(doc_id, f"{sentence(r, 50)} {passage} {sentence(r, 50)}") for _ in range(8)]
    got = remove_repeats(spark.createDataFrame(rows + rows[:2], "doc_id long, text string").repartition(3)).collect()
    assert len({g.text for g in got if passage in g.text}) == 1
    assert len({g.text for g in got}) == 8 and all(len(g.text.split()) in (100, 160) for g in got)


def test_links_are_closed_once(spark, monkeypatch):
    """A group of near copies has many links, a few for each band. Those that are certain are closed once; the closings after
    that take one link a node of them."""
    r = random.Random(5)
    base = [f"w{r.randrange(10**6)}" for _ in range(120)]
    copies = [" ".join(r.choice("xyz") * 5 if at in changed else w for at, w in enumerate(base)) for changed in (set(r.sample(range(120), 1)) for _ in range(150))]
    given, certain = [], []
    close, verify = simhash.components, simhash.verified
    monkeypatch.setattr(simhash, "components", lambda edges: given.append(edges.count()) or close(edges))
    monkeypatch.setattr(simhash, "verified", lambda pairs, *how: certain.append((pairs.count(), verify(pairs, *how).count())) or verify(pairs, *how))
    got = near_duplicates(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")).collect()
    assert len({g.group for g in got}) == 1 and sum(g.keep for g in got) == 1
    nodes, ((found, sure),) = len(set(copies)), certain
    assert sure > 2 * nodes
    assert given[0] == sure and given[1] <= found - sure + nodes and given[2] <= nodes
