"""The pipeline's stages on planted cases, and as a whole."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_dedup import linked, shingles
from tests.llm.test_models import targets
from tests.llm.test_tokens import crc
from tidemark.llm.common import stored
from tidemark.llm.mixing import words_of
from tidemark.llm.queries import QUERIES
from tidemark.llm.tokenizer import vocabulary

SF = "/root/testdata/sf0.001"


def text(r, n):
    return " ".join(" ".join("".join(r.choice("abcdefghij") for _ in range(4)) for _ in range(9)).capitalize() + "." for _ in range(n))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """300 clean documents; 40 toxic ones; exact and near copies; a passage that ten documents share."""
    r = random.Random(11)
    rows, kinds = [], {}

    def add(kind, t):
        kinds[len(rows)] = kind
        rows.append((len(rows), t, "en", f"s{len(rows) % 4}", len(t)))

    for _ in range(300):
        add("clean", text(r, 12))
    for _ in range(40):
        w = text(r, 8).split(" ")
        for _ in range(6):
            w.insert(r.randrange(len(w)), r.choice(["idiot", "moron", "you scum"]))
        add("toxic", " ".join(w))
    for i in range(10):
        add("copy", rows[i][1])
        w = rows[20 + i][1].split(" ")
        w[r.randrange(len(w))] = "zzzz"
        add("copy", " ".join(w))
    passage = text(r, 7)
    for _ in range(10):
        add("passage", text(r, 5) + " " + passage + " " + text(r, 5))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, 1, int(k == "toxic")) for i, k in kinds.items() if i % 3 or k == "toxic"]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder, kinds, passage


def test_stages(spark, planted):
    folder, kinds, passage = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, folder), name)
        assert docs.columns == columns and docs.where("n_chars <> length(text)").count() == 0
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    clean = {i for i, k in kinds.items() if k == "clean"}
    left = seen["toxicity"]
    assert not [i for i in left if kinds[i] == "toxic"] and clean <= set(left)
    left = seen["near_duplicates"]
    assert not [i for i in left if kinds[i] == "copy"] and clean <= set(left)
    left = seen["substrings"]
    assert sum(passage in t for t in left.values()) == 1
    before = seen["near_duplicates"]
    assert all(left[i] == before[i] for i in clean)
    mixed = docs.agg(F.sum(words_of(F.col("text")))).first()[0]
    assert abs(mixed - sum(len(t.split()) for t in left.values())) <= 4
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    sizes = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("m"))
    assert sizes.where("n <> m or n > 2048 or n < 1").count() == 0 and out.count() > 0


def repeated_words(texts):
    """For each text, words in lines that stand earlier, in those or in 30 words that do, and in those or in 16 such words."""
    lines, grams, out = set(), {16: set(), 30: set()}, []
    for text in texts:
        words, at = text.lower().split(), 0
        in_line, covered = [False] * len(words), {k: [False] * len(words) for k in grams}
        for line in text.split("\n"):
            n = len(line.split())
            if n >= 3:
                key = tuple(words[at : at + n])
                in_line[at : at + n] = [key in lines] * n
                lines.add(key)
            at += n
        for k, known in grams.items():
            for i in range(len(words) - k + 1):
                g = tuple(words[i : i + k])
                if g in known:
                    covered[k][i : i + k] = [True] * k
                known.add(g)
        out.append([sum(in_line), *(sum(a or b for a, b in zip(in_line, covered[k])) for k in (30, 16))])
    return out


def test_stages_against_brute_force(spark):
    """Every stage over its whole input, decided again one document, pair, passage, source and token at a time."""
    from tokenizers import Tokenizer

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        rows = sorted(docs.select("doc_id", "text", "source").collect(), key=lambda r: (r.doc_id, r.text or ""))
        seen.append(rows)
        docs = stored(stage(spark, docs, SF), name)
    given, mild, unique, cut, mixed = seen
    # Toxicity: what the scores of all documents reject, and nothing else.
    bad = {r.doc_id for r in QUERIES["op6_toxicity"](spark, SF).collect() if r.predicted}
    assert bad and mild == [r for r in given if r.doc_id not in bad]
    # Near-duplicates: all pairs of shingle sets; of each group the smallest id stays.
    sets = [set(shingles(r.text, 5)) for r in mild]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert pairs and unique == [mild[i] for i in sorted(set(linked(len(mild), pairs)))]
    # Substrings: repeated lines and passages go, nothing else does.
    assert [(r.doc_id, r.source) for r in cut] == [(r.doc_id, r.source) for r in unique]
    must = missed = 0
    for was, now, (line, long, most) in zip(unique, cut, repeated_words([r.text or "" for r in unique])):
        gone = len((was.text or "").split()) - len((now.text or "").split())
        assert line <= gone <= most, was.doc_id
        must, missed = must + long, missed + max(0, long - gone)
    assert must > 500 and missed < 0.01 * must
    # Mixing: sources at their targets, documents at most three times, one copy of each source cut.
    size = {r.doc_id: len((r.text or "").split()) for r in cut}
    sizes, taken, times, parts = Counter(), Counter(), Counter(), Counter()
    text_of = {r.doc_id: r.text for r in cut}
    for r in cut:
        sizes[r.source] += size[r.doc_id]
    for r in mixed:
        n = len(r.text.split())
        taken[r.source] += n
        times[r.doc_id] += n
        parts[r.source] += r.text != text_of[r.doc_id]
        assert text_of[r.doc_id].startswith(r.text)
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and max(parts.values()) <= 1
    assert all(n <= 3 * size[d] for d, n in times.items())
    # Packing: each copy's tokens once, sequences without gaps.
    t = Tokenizer.from_file(vocabulary())
    ids = defaultdict(list)
    for r in mixed:
        ids[r.doc_id].append([*t.encode(r.text, add_special_tokens=False).ids, 1])
    lengths, sequences = Counter(), defaultdict(list)
    for p in docs.collect():
        lengths[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
        assert p.ids_crc32 in {crc(x[p.start : p.start + p.length]) for x in ids[p.doc_id] if len(x) == p.doc_tokens}
    assert lengths == {d: sum(map(len, x)) for d, x in ids.items()}
    for own in sequences.values():
        ends = [0, *(a + n for a, n in sorted(own))]
        assert [a for a, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_odd_rows(spark, odd, tmp_path):
    """Nulls, empty and long texts, repeated rows and other columns go through every stage."""
    spark.createDataFrame([(3, 1, 0), (None, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "odd")
    assert docs.count() > 0
