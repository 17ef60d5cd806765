"""Toxicity, language-model scores, nearest neighbours, mixing."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, same
from tidemark.llm import ann, lm, mixing, toxicity
from tidemark.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scored(spark):
    return QUERIES["op6_toxicity"](spark, SF).toPandas()


def test_held_out_accuracy(spark, scored):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    m = scored.merge(labels, on="doc_id")
    m = m[m.held_out]
    assert (m.held_out == m.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 4 == 2)).all()
    right = (m.predicted == m.toxic).mean()
    assert right > max(m.toxic.mean(), 1 - m.toxic.mean()) + 0.02
    assert scored.score.between(0, 1).all() and (scored.predicted == (scored.score >= 0.3)).all()


def test_features():
    lexicon = {"idiot": 3.0, "scum": 2.0}
    hits = toxicity.finder([*lexicon, *toxicity.SECOND_PERSON])
    f = dict(zip(toxicity.FEATURES, toxicity._measure("You are an IDIOT! Not idiotic, 1d10t.", hits, lexicon)))
    assert f["hits"] == pytest.approx(math.log1p(1)) and f["top_weight"] == 3.0 and f["second_person_near"] == 1 / 4 and f["disguised_hits"] == 1
    assert toxicity._measure(None, hits, lexicon) == toxicity._measure("", hits, lexicon) == [0.0] * len(toxicity.FEATURES)


def test_many_hits():
    """The nearest pair by hand, in texts of few and of very many hits."""
    lexicon = {"idiot": 3.0}
    hits = toxicity.finder([*lexicon, *toxicity.SECOND_PERSON])
    near = lambda t: toxicity._measure(t, hits, lexicon)[toxicity.FEATURES.index("second_person_near")]
    assert near("you a b idiot") == near("idiot é 🎯 you") == 1 / 4 and near("idiot a you b c d idiot") == 1 / 3
    assert near("you " + "idiot " * 300_000) == 1 / 2 and near("you idiot " * 300_000) == 1 / 2
    assert near("you" + " x" * 300_000 + " idiot" * 300_000) == pytest.approx(1 / 300_002)


def test_toxicity_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (99, 1), (3, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels)
    odd = odd.withColumns({c: F.lit(1) for c in ("features", "x", "p", "prediction", "probability", "_x", "_p", "_features", "_text", "_raw", "raw", "_probability", "_calibrated", "calibrated", "predicted", "row")})
    out = toxicity.score(odd, model)
    assert out.columns == [*odd.columns, "toxicity"] and out.count() == odd.count()
    assert out.where("x = 1 and _x = 1 and p = 1 and _p = 1 and row = 1 and calibrated = 1").count() == odd.count()
    assert toxicity.score(out, model).columns == out.columns
    assert toxicity.score(empty, model).count() == 0 and model.trees is not None
    assert toxicity.fit(odd, labels.where("false")).base == 0.0
    assert toxicity.fit(odd, labels.where("toxic = 1")).base == 1.0


def test_lm(spark, documents, odd):
    docs = documents.select("doc_id", "text").unionByName(odd.where("doc_id is null or doc_id <> 7").select((F.col("doc_id") + 10_000).alias("doc_id"), "text"))
    rows = docs.collect()
    docs = spark.createDataFrame(rows, docs.schema).coalesce(3)
    got = lm.lm_scores(docs, block_bytes=100_000, range_bytes=50_000).toPandas()
    toks = [(r.doc_id, [*(r.text or "").encode().lower().split(), None]) for r in rows]
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in toks if not held(d) for w in t)
    n, v = sum(c.values()), len(c)
    want = Counter((d if d is not None else -1, held(d), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for d, t in toks)
    ours = Counter((int(r.doc_id) if r.doc_id == r.doc_id and r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got.itertuples())
    assert ours == want and set(got.train_tokens) == {n}
    new = got[got.held_out]
    assert new.score.sum() > new.base_score.sum() and np.isfinite(got.score).all()


@pytest.mark.parametrize("fan", [13, 1])
def test_lm_scores(spark, documents, fan):
    """Scores from counts taken one token at a time, with weights learned from those counts; over one level and two."""
    rows = documents.select("doc_id", "text").orderBy("doc_id").collect()
    got = {r.doc_id: r.score for r in lm.lm_scores(documents.coalesce(4), block_bytes=60_000, range_bytes=30_000, fan=fan).collect()}
    texts = {r.doc_id: [*(r.text or "").encode().lower().split(), None] for r in rows}
    learned = [d for d in texts if zlib.crc32(str(d).encode()) % 7 != 2]
    before = lambda ts: zip([None, None, *ts], [None, *ts], ts)
    c1 = Counter(w for d in learned for w in texts[d])
    c2 = Counter(p[1:] for d in learned for p in before(texts[d]))
    c3 = Counter(p for d in learned for p in before(texts[d]))
    n, v = sum(c1.values()), len(c1)

    def arrays(ts):
        rows = [(c1[w], c2[v, w], c3[u, v, w], c1[v], c1[None] if v is None else c2[u, v]) for u, v, w in before(ts)]
        return [np.array(c) for c in zip(*rows)]

    cells = Counter()
    for d in learned:
        a = arrays(texts[d])
        for cell, k in zip(*lm.histogram(*a, np.ones(len(a[0]), bool))):
            cells[int(cell)] += int(k)
    names = sorted(cells)
    m = lm.learn_weights(np.array(names), np.array([cells[c] for c in names], float), n, v, 60)
    for d, ts in texts.items():
        own = d in learned  # its tokens are scored with themselves deleted
        w, p, q, u, uv = (x - own for x in arrays(ts))
        k = m[lm.bucket(u, uv)]
        tri, bi = (np.divide(x, y, out=np.zeros(len(x)), where=y > 0) for x, y in ((q, uv), (p, u)))
        want = np.log10(k[:, 0] * tri + k[:, 1] * bi + k[:, 2] * w / (n - own) + k[:, 3] / (v + 1)).sum()
        assert got[d] == pytest.approx(want, rel=1e-6)
    assert m.sum(axis=1) == pytest.approx(np.ones(lm.BUCKETS))


def test_lm_reruns_agree(spark, documents):
    run = lambda: {r.doc_id: (r.score, r.base_score) for r in lm.lm_scores(documents, block_bytes=60_000, range_bytes=30_000).collect()}
    assert run() == run()


def test_lm_wide_counts(spark):
    """Counts above 2 ** 32 are summed and sent whole."""
    for a in ([0], [255, 256], [1 << 40, 3], [(1 << 62) + 1]):
        assert lm.counts_of(lm.planes(np.array(a))).tolist() == a
    lists = [(b, 0, k, bytearray(lm.short(np.array([5, 9], np.uint64), 8 if not k else 5)), bytearray(lm.planes(np.array([3 << 40, b])))) for b in (1, 2) for k in (0, 1, 2)]
    got = lm.summed(spark.createDataFrame(lists, lm.LISTS), 2, 2).collect()
    assert len(got) == 6 and all(lm.counts_of(r.totals).tolist() == [6 << 40, 3] for r in got)
    assert sum(r.n for r in got) == (6 << 40) + 3 and sum(r.v for r in got) == 2
    assert lm.bucket(np.array([1 << 50]), np.array([1 << 45]))[0] == lm.DEGREES - 1


def test_lm_tells_repeats(spark, documents):
    """Documents that occur twice score above the others per token, as their three-word contexts go on as before."""
    rows = [(r.doc_id, r.text) for r in documents.where("n_chars > 400").dropDuplicates(["text"]).collect()]
    twice = [(100_000 + d, t) for d, t in rows[::9]]
    got = lm.lm_scores(spark.createDataFrame(rows + twice, "doc_id long, text string")).toPandas()
    per = (got.score / got.n_tokens).groupby(got.doc_id.isin([d for d, _ in rows[::9] + twice])).median()
    assert per[True] > per[False] + 0.5


def test_lm_empty(empty):
    assert lm.lm_scores(empty).count() == 0


def test_em_finds_the_mixture():
    cell = lambda q: ((5 * lm.TRI + q) * lm.BI + 31) * lm.UNI + 20
    m = lm.learn_weights(np.array([cell(2), cell(lm.TRI - 1)]), np.array([3e6, 1e6]), 1 << 30, 1000, 200)
    assert m.sum(axis=1) == pytest.approx(np.ones(lm.BUCKETS)) and m[5, 0] > 0.5
    assert not m[lm.DEGREES :, 0].any() and not m[lm.DEGREES, 1] and (m[:, 3] > 0).all()


def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 16))
    rows = [(i, [float(v) for v in x[i]]) for i in range(3000)]
    rows += [(4000 + i, rows[17][1]) for i in range(40)] + [(5000, [0.0] * 16), (5001, None), (5002, [float("nan")] * 16), (5003, [1.0, None] * 8), (5004, [1.0] * 3), (None, rows[0][1]), (5005, [float("inf")] + [0.0] * 15), (5006, []), (5050, [v * 1e200 for v in rows[3][1]]), (5, rows[5][1])]
    return spark.createDataFrame([(*r, 1.0, 2) for r in rows], "vec_id long, embedding array<double>, score double, rank int")


def test_nearest(spark):
    frame = vectors(spark)
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=700).toPandas()
    own = {r.vec_id: np.array(r.embedding) for r in frame.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)}
    ids = np.array(sorted(own))
    unit = np.stack([own[i] / np.abs(own[i]).max() for i in ids])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    hits = total = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        sims = unit @ unit[np.searchsorted(ids, q)]
        sims[np.searchsorted(ids, q)] = -9
        best = ids[np.lexsort((ids, -sims.round(13)))[:5]]
        hits, total = hits + len(set(best) & set(g.vec_id)), total + 5
        assert g["rank"].tolist() == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
        assert np.allclose(g.score, sims[np.searchsorted(ids, g.vec_id)], atol=1e-12) and (np.diff(g.score) <= 0).all()
    assert set(got.query_id) == {i for i in own if i % 50 == 0} and hits / total >= 0.9
    same_vectors = got[got.query_id == 4000].sort_values("rank").vec_id.tolist()
    assert same_vectors == [17, 4001, 4002, 4003, 4004]


def shapes():
    r = np.random.default_rng(3)
    pick = lambda n, d: r.normal(size=(n, d))[r.integers(0, n, 2500)]
    yield "clusters", pick(25, 32) + r.normal(size=(2500, 32)) * 0.05
    yield "scaled copies", pick(10, 32) * np.exp(r.normal(size=(2500, 1)) * 3) + r.normal(size=(2500, 32)) * 0.01
    for spread in (1e-2, 1e-4, 1e-6):
        yield f"three clusters of spread {spread}", pick(3, 32) + r.normal(size=(2500, 32)) * spread
    yield "no clusters", r.normal(size=(2500, 64))


@pytest.mark.parametrize("name,x", list(shapes()), ids=lambda v: v if isinstance(v, str) else "")
def test_graph_recall(name, x):
    x = ann._unit(x)
    g = ann.Graph(x)
    hits = 0
    for i in range(0, 2500, 25):
        sims = x @ x[i]
        sims[i] = -9
        near = g.find(x[i], 48, 120)
        near = near[near != i]
        hits += (np.sort(x[near] @ x[i])[-5:] >= np.sort(sims)[-5] - 1e-15).sum()
    assert hits >= 0.9 * 500


def test_nearest_routes(spark):
    """On clustered data a query meets a few of the cells, with recall 0.9 and more against brute force."""
    r = np.random.default_rng(5)
    x = r.normal(size=(30, 24))[r.integers(0, 30, 4000)] + r.normal(size=(4000, 24)) * 0.1
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = ann.build(ann.usable(frame, "vec_id", "embedding"), shard_rows=200)
    assert len(index.centroids) == 20 and index.probes <= 5 and sum(map(len, index.shards)) == index.graphs.count()
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=200).toPandas()
    unit = ann._unit(x)
    hits = 0
    for q, own in got.groupby("query_id"):
        sims = unit @ unit[q]
        sims[q] = -9
        hits += len(set(np.argsort(-sims)[:5].tolist()) & set(own.vec_id))
    assert hits >= 0.9 * 5 * 80


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_nearest_recall_on_tables(spark, sf):
    frame = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, shard_rows=500).toPandas()
    rows = frame.toPandas()
    unit = ann._unit(np.array(rows.embedding.tolist(), float))
    ids = rows.vec_id.to_numpy()
    hits = 0
    for q, own in got.groupby("query_id"):
        sims = unit @ unit[np.flatnonzero(ids == q)[0]]
        sims[ids == q] = -9
        hits += (own.score.to_numpy() >= np.sort(sims)[-5] - 1e-12).sum()
    assert hits >= 0.9 * len(got)


def test_nearest_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 0.1]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(few, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, 1, 50), (0, 2, 3), (50, 1, 0), (50, 2, 3)]
    assert ann.nearest(few.where("false"), F.lit(True)).count() == 0


def targets(sizes, weights=(1, 2, 3), most=3):
    """Water filling, step by step."""
    names = sorted(sizes, key=lambda n: (n is None, n or ""))
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, active, out = float(sum(sizes.values())), set(names), {}
    while active:
        level = left / sum(w[n] for n in active)
        over = [n for n in active if level * w[n] > most * sizes[n]]
        if not over:
            return out | {n: level * w[n] for n in active}
        for n in over:
            out[n] = float(most * sizes[n])
            left -= out[n]
            active.remove(n)
    return out


def check_mix(plan, sizes):
    want = targets(sizes)
    for (source, own) in plan.groupby("source", dropna=False):
        name = None if source is None or source != source else source
        assert abs(own.target.iloc[0] - want[name]) < 1e-6 * max(1, want[name])
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 0.5
        assert (own.source_size == sizes[name]).all()
    assert (plan.taken <= 3 * plan["size"]).all()
    assert (plan.draws.map(lambda d: sum(x["words"] for x in d)) == plan.taken).all()


def test_mixing(spark, documents, odd, empty):
    for docs in (documents, odd, documents.where("source in ('src0', 'src1') or doc_id % 50 = 2")):
        rows = docs.select("source", mixing.words_of(F.col("text")).alias("n")).groupBy("source").agg(F.sum("n")).collect()
        plan = mixing.plan_mix(docs).toPandas()
        assert len(plan) == docs.count()
        check_mix(plan, {r[0]: r[1] for r in rows})
    again = mixing.plan_mix(documents.repartition(7)).toPandas().sort_values("doc_id")
    first = mixing.plan_mix(documents).toPandas().sort_values("doc_id")
    assert again.taken.tolist() == first.taken.tolist()
    assert mixing.plan_mix(empty).count() == mixing.mix(empty).count() == 0


def test_mixed_rows(spark, documents, odd):
    for docs in (documents, odd):
        plan, out = mixing.plan_mix(docs, shard_levels=3), mixing.mix(docs, shard_levels=3)
        assert out.columns == [*docs.columns, "mix_copy", "mix_shard", "mix_place"]
        assert out.agg(F.coalesce(F.sum(mixing.words_of(F.col("text"))), F.lit(0))).first()[0] == plan.agg(F.sum("taken")).first()[0]


def test_shards_hold_the_mix(spark, documents):
    """Each draw is in one shard; the shards' words sum to the targets; repeated and null ids with other texts differ in place."""
    plan = mixing.plan_mix(documents, shard_levels=4)
    by_shard = plan.select(F.explode("draws").alias("d")).groupBy("d.shard").agg(F.sum("d.words").alias("n"), F.count("*").alias("rows")).toPandas()
    total = plan.agg(F.sum("taken")).first()[0]
    assert len(by_shard) == 16 and by_shard.n.sum() == total and by_shard.n.max() < 2 * total / 16
    same_id = documents.withColumn("doc_id", F.lit(None).cast("long"))
    blocks = mixing.plan_mix(same_id, blocks_per_source=64).select(F.explode("draws").alias("d")).select("d.place").distinct().count()
    assert blocks > documents.select("text").distinct().count() / 2


def test_mix_columns_that_clash(spark, odd):
    """The mix's own columns replace those named like them; without places all of docs' columns come back as they were."""
    docs = odd.withColumn("mix_shard", F.lit("mine")).withColumn("Mix_Place", F.col("doc_id")).withColumn("mix_draw", F.lit(7))
    out = mixing.mix(docs, shard_levels=2)
    assert out.columns == [*odd.columns, "mix_draw", "mix_copy", "mix_shard", "mix_place"] and out.where("mix_shard not between 0 and 3").isEmpty()
    kept = mixing.mix(docs, shard_levels=2, places=False)
    assert kept.columns == docs.columns and kept.count() == out.count() > 0
    assert kept.where("mix_shard <> 'mine' or mix_draw <> 7 or not (Mix_Place <=> doc_id)").isEmpty()


def test_splitting_tree(spark):
    quotas = {"a": 700, "b": 41, "c": 0, None: 259}
    rows = spark.createDataFrame(list(quotas.items()), "source string, quota long")
    got = mixing.split_quotas(rows, 3, 7).collect()
    for s, q in quotas.items():
        own = sorted((r.shard, r.first, r.quota) for r in got if r.source == s)
        assert sum(x[2] for x in own) == q and [x[1] for x in own] == list(np.cumsum([0, *(x[2] for x in own[:-1])]))
    shards = Counter()
    for r in got:
        shards[r.shard] += r.quota
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1


def test_hypergeometric(spark):
    """Frequencies over many uniforms against exact probabilities."""
    n = 20_000
    rows = spark.range(n).select(mixing.hypergeometric(F.lit(50), F.lit(12), F.lit(20), (F.col("id") + 0.5) / n).alias("x"))
    got = Counter(r.x for r in rows.collect())
    for x in range(13):
        p = math.comb(12, x) * math.comb(38, 20 - x) / math.comb(50, 20)
        assert abs(got[x] / n - p) < 2e-4
    edge = spark.range(1).select(mixing.hypergeometric(F.lit(5), F.lit(5), F.lit(3), F.lit(0.7)).alias("a"), mixing.hypergeometric(F.lit(5), F.lit(0), F.lit(3), F.lit(0.7)).alias("b"), mixing.hypergeometric(F.lit(0), F.lit(0), F.lit(0), F.lit(0.7)).alias("c")).first()
    assert tuple(edge) == (3, 0, 0)


def test_mixing_sql(spark):
    assert same(QUERIES["op10_mixing"](spark, SF), connect(SF), SQL["op10_mixing"]) > 0


def test_mixing_is_native(spark, documents):
    plan = mixing.plan_mix(documents)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
