"""Folds and replays against the rules applied one operation at a time."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reads, reports, sessions, state, telemetry, traffic, verifier

SCHEMA = "key string, seq long, at_ms long, op string, rv long, fv long, version long"


def model(ops):
    """applied flags and final entries by the compare-and-set rules, in order."""
    entries, flags = {}, []
    for key, seq, _, op, rv, fv, v in sorted(ops, key=lambda o: o[1]):
        e = entries.setdefault(key, {"rv": None, "fv": None, "tv": 0})
        if op == "fill":
            ok = rv >= e["tv"] and (e["rv"] is None or (rv, fv) > (e["rv"], e["fv"]))
            if ok:
                e["rv"], e["fv"] = rv, fv
        else:
            ok = v > (-1 if e["rv"] is None else e["rv"]) and v > e["tv"]
            if ok:
                e["tv"], e["rv"], e["fv"] = v, None, None
        flags.append((seq, ok))
    return flags, {k: (e["rv"], e["fv"]) for k, e in entries.items() if e["rv"] is not None}


def history(seed, n=400):
    r = random.Random(seed)
    out = []
    for i in range(n):
        key = f"k:{r.randrange(12)}"
        if r.random() < 0.6:
            out.append((key, i, i * 1000, "fill", r.randrange(1, 12), r.randrange(1, 6), None))
        else:
            out.append((key, i, i * 1000, "tombstone", None, None, r.randrange(1, 12)))
    return out


def replayed_live(ops):
    """Entries after a replay in which a tombstone keeps what it buried from coming back."""
    return model(ops)[1]


@pytest.mark.parametrize("seed", range(4))
def test_fold_any_order(spark, seed):
    ops = history(seed)
    want = replayed_live(ops)
    random.Random(seed).shuffle(ops)
    got = state.fold_state(spark.createDataFrame(ops + ops[:50], SCHEMA)).where("live").collect()
    assert {r.key: (r.rv, r.fv) for r in got} == want


@pytest.mark.parametrize("seed", range(4))
def test_applied(spark, seed):
    ops = history(seed + 10)
    got = state.replay_applied(spark.createDataFrame(ops, SCHEMA)).select("seq", "applied").collect()
    assert sorted(map(tuple, got)) == sorted(model(ops)[0])


def test_precision(spark):
    ops = [("k:1", 1, 1, "fill", 2**53 + 1, 1, None), ("k:1", 2, 2, "fill", 2**53 + 2, 1, None)]
    assert state.fold_state(spark.createDataFrame(ops, SCHEMA)).first().rv == 2**53 + 2


def test_empty_fold(spark):
    assert state.fold_state(spark.createDataFrame([], SCHEMA)).count() == 0


def hlc_model(ops):
    last, out = 0, []
    for _, seq, clock, wall, v in ops:
        if clock == "next":
            last = wall << 16 if wall << 16 > last else last + 1
        else:
            last = max(last, v if clock == "observe" else wall << 16)
        out.append((seq, last))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hlc(spark, seed):
    r = random.Random(seed)
    ops = [("s", i, r.choice(["next", "next", "now", "observe"]), r.randrange(1000, 1010), r.randrange(1000, 1010) << 16 | r.randrange(5)) for i in range(300)]
    got = state.stamp_hlc(spark.createDataFrame(ops, "shard string, seq long, clock string, wall_ms long, v long")).select("seq", "hlc").collect()
    assert sorted(map(tuple, got)) == hlc_model(ops)


def test_hlc_counter_borrows(spark):
    rows = spark.range(65_537).select(F.lit("s").alias("shard"), F.col("id").alias("seq"), F.lit("next").alias("clock"), F.lit(7000).alias("wall_ms"), F.lit(None).cast("long").alias("v"))
    top = state.stamp_hlc(rows).agg(F.max("hlc")).first()[0]
    assert (top >> 16, top & 65535) == (7001, 0)


def test_expiry(spark):
    rows = [("k:1", i, t, "fill", 1, 1, None) for i, t in enumerate([0, 50, 90, 300, 310, 900])]
    got = state.expiry_epochs(spark.createDataFrame(rows, SCHEMA), 100).orderBy("seq").collect()
    assert [r.epoch for r in got] == [1, 1, 1, 2, 2, 3]


def test_latest(spark):
    rows = spark.createDataFrame([(1, 1, 5, "a"), (1, 1, 7, "b"), (1, 2, 1, "c")], "a int, b int, v int, x string")
    assert sorted(map(tuple, state.latest_by_key(rows, ["a", "b"], "v", []).collect())) == [(1, 1, 7, "b"), (1, 2, 1, "c")]


P = verifier.propagation_bound()


@pytest.mark.parametrize(
    "late,fv,watermark,window,levels",
    [
        (P - 1, 100, None, 0, []), (P, 100, None, 0, []), (P + 1, 100, None, 0, ["EVENTUAL"]), (P + 1, 100, 150, 0, ["SESSION", "EVENTUAL"]),
        (P + 1, 150, 150, 0, ["EVENTUAL"]), (P + 1, 100, None, 3_600_000, ["EVENTUAL"]), (P + 1000, 100, None, 1, ["BOUNDED", "EVENTUAL"]),
    ],
)
def test_levels(spark, late, fv, watermark, window, levels):
    rows = spark.createDataFrame([(1_000_000 + late, True, 1_000_000, fv, watermark, window)], "at_ms long, behind boolean, behind_since_ms long, fv long, watermark long, window_ms long")
    assert verifier.classify(rows, P).first().levels == levels


def test_behind_runs(spark):
    rows = [("k", i, i, b) for i, b in enumerate([False, True, True, False, True, None, True])]
    got = verifier.behind_since(spark.createDataFrame(rows, "key string, at_ms long, seq long, behind boolean")).orderBy("seq").collect()
    assert [r.behind_since_ms for r in got] == [None, 1, 1, None, 4, None, 6]


@pytest.mark.parametrize("clean,bad,consistency", [(100, 0, 1.0), (99, 1, 0.99), (999, 1, 0.999)])
def test_slo(spark, clean, bad, consistency):
    rows = spark.createDataFrame([("EVENTUAL", False)] * clean + [("EVENTUAL", True)] * bad, "level string, violation boolean")
    assert abs(verifier.slo_report(rows).first().consistency - consistency) < 1e-12


WRITERS = {"correct": (0, 0), "ttl_only": (1, 0), "delete_before_commit": (0, 1), "racy": (1, 1)}


@pytest.mark.parametrize("writer", WRITERS)
def test_writers(spark, writer):
    """Three broken writers leave a key behind for longer than the bound; the correct one never does."""
    misses, races = WRITERS[writer]
    stay = 60_000 if misses or races else 1000
    rows = [(f"k:{k}", t, t + k, 1000 <= t < 1000 + stay) for k in range(5) for t in range(0, 120_000, 500)]
    obs = verifier.behind_since(spark.createDataFrame(rows, "key string, at_ms long, seq long, behind boolean"))
    obs = obs.withColumns({"fv": F.lit(1), "watermark": F.lit(None).cast("long"), "window_ms": F.lit(0)})
    found = verifier.classify(obs, P).where(F.size("levels") > 0).count()
    assert (found > 0) == (writer != "correct")


@pytest.mark.parametrize("reads_,writes,before,want", [(1000, 10, None, True), (100, 100, True, False), (150, 10, True, True), (150, 10, False, False), (3, 1, None, True), (500, 0, None, True)])
def test_admission(spark, reads_, writes, before, want):
    forced = [("k", 0, 1000, 10 if before else 1000, 100.0 if before else 1.0)] if before is not None else []
    rows = spark.createDataFrame([*forced, ("k", 1, reads_, writes, reads_ / writes if writes else float("inf"))], "key string, slice long, reads long, writes long, ratio double")
    assert traffic.admission(rows, 20, 10, 20).where("slice = 1").first().admitted is want


def test_admission_thresholds(spark):
    with pytest.raises(ValueError):
        traffic.admission(spark.range(1), 10, 20)


def test_run_figures(spark):
    rows = spark.createDataFrame([(1, 5.0, 10_000.0, 3), (1, 6.0, 100_000.0, 0), (1, 7.0, 12_000.0, 4), (2, 1.0, 1.0, 0)], "phase int, p50_us double, p99_us double, errors int")
    got = {r.phase: r for r in reports.run_figures(rows, "phase").collect()}
    assert (got[1].p99_us, got[1].p99_least, got[1].p99_most, got[1].errors, got[1].sufficient) == (12_000, 10_000, 100_000, 7, True)
    assert not got[2].sufficient


def test_update_where(spark):
    rows = spark.createDataFrame([(i, f"s{i % 2}", i < 8) for i in range(20)], "id long, shard string, hit boolean")
    whole = {r.shard: r for r in reads.update_where(rows, F.col("hit"), "id", 10).collect()}
    assert whole["s0"]["keys"] == [0, 2, 4, 6] and not whole["s0"].degraded
    cut = reads.update_where(rows.where("hit or id = 9"), F.lit(True), "id", 4).collect()
    assert all(r["keys"] == [] for r in cut) and {r.shard: (r.matched, r.degraded) for r in cut} == {"s0": (4, False), "s1": (5, True)}


def test_leases(spark):
    rows = spark.createDataFrame([("k", i, i) for i in range(500)], "key string, seq long, at_ms long")
    got = dict(reads.lease_outcomes(rows).groupBy("outcome").count().collect())
    assert got["granted"] == 1 and got["waited"] + got["granted"] + got["wait_exhausted"] == 500


def test_leases_end(spark):
    """A lease ends lease_ms after its grant, however often its key is asked for meanwhile, or with a fill."""
    hour = 3_600_000
    r = random.Random(3)
    misses = [("day", i, i * hour) for i in range(25)] + [(f"k{r.randrange(6)}", 100 + i, r.randrange(40 * hour)) for i in range(400)]
    fills = [(f"k{r.randrange(6)}", 1000 + i, r.randrange(40 * hour)) for i in range(30)]
    for with_fills in (False, True):
        want, grants = {}, {}
        for key, seq, at in sorted(misses + fills * with_fills, key=lambda m: (m[2], m[1])):
            if seq >= 1000:
                grants.pop(key, None)
                continue
            new = key not in grants or at - grants[key] >= 4 * hour
            grants[key] = at if new else grants[key]
            since = at - grants[key]
            want[seq] = (since, "granted" if new else "waited" if since <= 75 else "wait_exhausted")
        frame = lambda x: spark.createDataFrame(x, "key string, seq long, at_ms long").repartition(5)
        out = reads.lease_outcomes(frame(misses), 4 * hour, fills=frame(fills) if with_fills else None)
        assert {g.seq: (g.since_ms, g.outcome) for g in out.collect()} == want
        assert sum(want[i][1] == "granted" for i in range(25)) == 7
    # Every 1.5 s under a lease of 2 s: every second one is granted.
    often = reads.lease_outcomes(frame([("k", i, 1500 * i) for i in range(8)])).orderBy("seq").collect()
    assert [g.outcome == "granted" for g in often] == [True, False] * 4


def test_recent_keys(spark):
    """A key in the list isn't moved, the oldest goes, and comes in again."""
    def held(keys, most):
        rows = spark.createDataFrame([("a", i, k) for i, k in enumerate(keys)], "shard string, seq long, key string")
        return [r.key for r in traffic.recent_keys(rows, most).orderBy("place").collect()]

    assert held("ABCA", 2) == ["C", "A"] and held("ABA", 2) == ["A", "B"] and held("AABBC", 10) == ["A", "B", "C"] and held("", 2) == []


def test_rolling_windows(spark):
    """Against every window counted by itself; equal times, gaps, blocks of no length that divides the window, no time."""
    r = random.Random(7)
    rows = [(lv, r.choice([None, *range(-40, 400)]) if lv == "A" else r.randrange(10**6), r.random() < 0.3, i) for i in range(600) for lv in "AB"]
    obs = spark.createDataFrame(rows, "level string, at_ms long, violation boolean, _n int")
    for window, blocks in ((7, 64), (100, 3), (1, 1)):
        near = lambda a, b: a == b if None in (a, b) else a - window < b <= a
        want = {(lv, i): ([v for l, t, v, _ in rows if l == lv and near(at, t)]) for lv, at, _, i in rows}
        got = verifier.slo_rolling(obs, window, blocks)
        assert got.columns == [*obs.columns, "observations", "violations", "nines"]
        assert {(g.level, g._n): (g.observations, g.violations) for g in got.collect()} == {k: (len(v), sum(v)) for k, v in want.items()}
    frames = verifier.slo_rolling(obs, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, -" not in frames  # a sliding frame is summed anew for each row


def test_crowded_sketch(spark):
    """Keys that share all of their cells with others get their own counts, also where a window has cleared them."""
    log = spark.createDataFrame([(f"k{i}", i % 2) for i in range(60) for _ in range(i % 5 + 1)], "key string, slice long")
    cells = F.array(*(F.pmod(F.hash("key", F.lit(r)), F.lit(16)) for r in range(4)))
    rough = {r.key: r.estimate for r in traffic.sketch_estimates(log, traffic.sketch(log, cells), cells).collect()}
    assert len(rough) == 60 and all(rough[f"k{i}"] >= i % 5 + 1 for i in range(60)) and sum(rough.values()) > 180
    got = {r.key: r.estimate for r in traffic.sketch_estimates(log, traffic.sketch(log, cells), cells, log).collect()}
    assert got == {f"k{i}": i % 5 + 1 for i in range(60)}
    now = traffic.sketch_at(traffic.sketch(log, cells, "slice"), 1, 1)
    got = {r.key: r.estimate for r in traffic.sketch_estimates(log, now, cells, log.where("slice = 1")).collect()}
    assert got == {f"k{i}": (i % 5 + 1) * (i % 2) for i in range(60)}
    assert traffic.sketch_width(150) == 4096 and traffic.sketch_width(90_000) >= 16 * 90_000


def test_update_where_keeps_the_keys_type(spark):
    rows = spark.createDataFrame([("entities:1", "s", True), ("entities:2", "s", True)], "id string, shard string, hit boolean")
    assert reads.update_where(rows, F.col("hit"), "id", 5).first()["keys"] == ["entities:1", "entities:2"]
    assert reads.update_where(rows, F.col("hit"), "id", 1).first()["keys"] == []


def test_hlc_blocks(spark):
    """Blocks don't show in the readings; against the recurrence, step by step."""
    r = random.Random(8)
    rows = [("a", i, r.choice(["next", "now", "observe"]), r.randrange(50), r.randrange(60) << 16 | r.randrange(4)) for i in range(400)]
    want, last = {}, 0
    for _, seq, clock, wall, v in rows:
        last = max(last + 1, wall << 16) if clock == "next" else max(last, v if clock == "observe" else wall << 16)
        want[seq] = last
    frame = spark.createDataFrame(rows, "shard string, seq long, clock string, wall_ms long, v long").repartition(3)
    for size in (7, 65_536):
        assert {g.seq: g.hlc for g in state.stamp_hlc(frame, block_rows=size).collect()} == want


def test_expiry(spark):
    """Losing writes don't keep an entry alive."""
    rows = [("k", 1, "fill", 0, 9, 1, None), ("k", 2, "fill", 900, 3, 2, None), ("k", 3, "fill", 1500, 4, 3, None), ("k", 4, "tombstone", 1600, None, None, 8), ("k", 5, "fill", 1700, 8, 5, None)]
    got = state.expiry_epochs(spark.createDataFrame(rows, "key string, seq long, op string, at_ms long, rv long, fv long, version long"), 1000).orderBy("seq").collect()
    assert [(g.epoch, g.applied) for g in got] == [(1, True), (1, False), (2, True), (2, True), (2, True)]


def test_client_cap(spark):
    rows = spark.createDataFrame([("a", f"s{i}", i) for i in range(100)], "session string, shard string, version long")
    kept = sessions.session_tokens(rows).collect()
    assert len(kept) == 64 and min(r.watermark for r in kept) == 36


def test_hit_rate(spark):
    rows = spark.createDataFrame([("hit",)] * 900 + [("miss",)] * 80 + [("stale",)] * 20, "outcome string")
    assert telemetry.hit_rate(rows).first().hit_rate == 0.9


LEVELS = ["STRONG", "SESSION", "BOUNDED", "EVENTUAL"]


@pytest.mark.parametrize("level", LEVELS)
def test_read_matrix(spark, level):
    """An entry older than the session's own write, one written by others long ago, a fresh one, and an absent row."""
    now = 1_700_000_000_000
    entries = spark.createDataFrame([("own", 5, (now - 2000) << 16, True, False), ("old", 5, (now - 60_000) << 16, True, False), ("new", 5, (now - 100) << 16, True, False), ("gone", 0, (now - 100) << 16, True, True)], "key string, rv long, fv long, live boolean, negative boolean")
    origin = spark.createDataFrame([("own", 9), ("old", 5), ("new", 5)], "key string, version long")
    asked = spark.createDataFrame([(i, k, level, 5000, (now - 1000) << 16 if k == "own" else None, now) for i, k in enumerate(["own", "old", "new", "gone", "none"])], "seq long, key string, level string, bound_ms long, watermark long, at_ms long")
    got = {r.key: r.outcome for r in reads.resolve_reads(asked, entries, origin).collect()}
    want = {
        "STRONG": dict.fromkeys(got, "bypass"),
        "SESSION": {"own": "stale", "old": "hit", "new": "hit", "gone": "negative_hit", "none": "miss"},
        "BOUNDED": {"own": "stale", "old": "stale", "new": "hit", "gone": "negative_hit", "none": "miss"},
        "EVENTUAL": {"own": "hit", "old": "hit", "new": "hit", "gone": "negative_hit", "none": "miss"},
    }[level]
    assert got == want
