"""Stateful processors for what depends on the order of events: dwell times, recency-bounded tokens, behind timers, and
entries with a time to live.

State is keyed, so it spreads over executors; each key's state is bounded (a decision, at most `most` watermarks, a time).
Rows are ordered inside a micro-batch; across micro-batches they count in the order in which the batches come, so a
source whose order matters must deliver it in order (a log's offsets do)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def with_dwell(ratios: DataFrame, admit: float, evict: float, dwell: int, default: bool = True) -> DataFrame:
    """ratios (key, slice, ratio), streaming: the admission decision after each, which holds for at least `dwell`
    slices once it has changed."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        admitted, since = state.get if state.exists else (default, -(1 << 60))
        rows = pd.concat(list(batches)).sort_values("slice")
        out = []
        for at, ratio in zip(rows["slice"], rows["ratio"]):
            wanted = True if ratio >= admit else False if ratio < evict else admitted
            if wanted != admitted and at - since >= dwell:
                admitted, since = wanted, int(at)
            out.append((key[0], int(at), bool(admitted)))
        state.update((bool(admitted), int(since)))
        yield pd.DataFrame(out, columns=["key", "slice", "admitted"])

    return ratios.groupBy("key").applyInPandasWithState(run, "key string, slice long, admitted boolean", "admitted boolean, since long", "append", GroupStateTimeout.NoTimeout)


def token_stream(advances: DataFrame, most: int = 64) -> DataFrame:
    """advances (session, seq, shard, version), streaming: each session's token after a batch, shard by shard, the
    least recently advanced shards dropped past `most`; degraded once any was dropped."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shards, versions, dropped = state.get if state.exists else ([], [], False)
        token = dict(zip(shards, versions))
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable").itertuples():
            token[row.shard] = max(int(row.version), token.pop(row.shard, 0))  # to the end: used last
            if len(token) > most:
                token.pop(next(iter(token)))
                dropped = True
        state.update((list(token), list(token.values()), dropped))
        yield pd.DataFrame([(key[0], s, v, dropped) for s, v in token.items()], columns=["session", "shard", "watermark", "degraded"])

    return advances.groupBy("session").applyInPandasWithState(run, "session string, shard string, watermark long, degraded boolean", "shards array<string>, versions array<long>, dropped boolean", "update", GroupStateTimeout.NoTimeout)


def behind_stream(observations: DataFrame) -> DataFrame:
    """observations (key, at_ms, seq, behind), streaming, with behind_since_ms: the first observation of the current run
    of behind ones; the same as the batch form."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since = state.get[0] if state.exists else None
        out = []
        for row in pd.concat(list(batches)).sort_values(["at_ms", "seq"], kind="stable").itertuples():
            behind = row.behind is not None and not pd.isna(row.behind) and bool(row.behind)
            since = (int(row.at_ms) if since is None else since) if behind else None
            out.append((key[0], int(row.at_ms), int(row.seq), since))
        state.update((since,))
        rows = pd.DataFrame(out, columns=["key", "at_ms", "seq", "behind_since_ms"])
        yield rows.astype({"behind_since_ms": "Int64"})

    return observations.groupBy("key").applyInPandasWithState(run, "key string, at_ms long, seq long, behind_since_ms long", "since long", "append", GroupStateTimeout.NoTimeout)


def expiring_stream(ops: DataFrame, ttl_ms: int) -> DataFrame:
    """ops (key, seq, op, at_ms, rv, fv, version), streaming, with epoch and applied as expiry_epochs has them: entries end
    ttl_ms after the last write that won, by the operations' own times."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        epoch, rv, fv, tomb, ends = state.get if state.exists else (1, None, None, None, None)
        out = []
        rows = pd.concat([b.astype({"rv": "Int64", "fv": "Int64", "version": "Int64"}) for b in batches])
        for row in rows.sort_values("seq", kind="stable").itertuples():
            if ends is not None and row.at_ms >= ends:
                epoch, rv, fv, tomb, ends = epoch + 1, None, None, None, None
            if row.op == "fill":
                won = row.rv >= (tomb or 0) and (rv is None or (row.rv, row.fv) > (rv, fv))
                rv, fv = (int(row.rv), int(row.fv)) if won else (rv, fv)
            else:
                won = row.version > (-1 if rv is None else rv) and row.version > (tomb or 0)
                rv, fv, tomb = (None, None, int(row.version)) if won else (rv, fv, tomb)
            ends = int(row.at_ms) + ttl_ms if won else ends
            out.append((key[0], int(row.seq), epoch, bool(won)))
        state.update((epoch, rv, fv, tomb, ends))
        yield pd.DataFrame(out, columns=["key", "seq", "epoch", "applied"])

    return ops.groupBy("key").applyInPandasWithState(run, "key string, seq long, epoch long, applied boolean", "epoch long, rv long, fv long, tomb long, ends long", "append", GroupStateTimeout.NoTimeout)
