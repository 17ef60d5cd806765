"""Removal of repeated passages: digests of lines, and sampled digests of word sequences for passages inside lines.

A document is a sequence of words (case and white space don't count), cut into lines. Two kinds of units have a 64-bit
digest: every line of line_words words or more, and anchors. All units are grouped over all documents by digest, the
earliest occurrence, by document and then position, is kept, and the others are removed. Fewer words than line_words
(3) repeat by chance and are no copies; set it to 1 to remove such lines as well.

Anchors find passages that begin or end inside lines. Every sequence of `gram` words has a digest; an anchor is a place
whose digest is the least of some `window` neighbouring ones in the document, so about one word in eight has an anchor,
in any language, and every window has one. Which places are anchors depends on the words of the window alone, and
gram + window - 1 = min_words: a passage of min_words words has the same anchors wherever it stands. A later occurrence
of an anchor is extended to both sides while its words equal those beside the kept one: by window - 1 words at most, as
a longer passage has its next anchor there. What a document's extended anchors cover together without a gap is removed
if it has at least min_words words. Offsets are positions in the original text, in code points.

So a repeated line goes, and a passage of min_words words or more that stands in an earlier document, or earlier in the
same one, goes whole from its first word to its last. One case keeps less than window words at an end: where the anchor
nearest to that end stands in a still earlier place too, it is extended against that one. Each removed word stands with
its neighbours in an earlier place. A text that repeats itself without a pause (periods shorter than min_words too)
keeps its first period. Words beside an anchor are compared by 16 bits of their hashes, so one end in 65,536 may be a
word too long.

Units are taken from the texts twice, once with the words beside the anchors for the earliest occurrences and once
without them for the later ones: storing all of them once would take more disk than the texts.

Defined cases: null texts stay null, empty ones empty, with no spans; documents rank by id, null ids last, and then by a
hash of the text, so different texts of one id or without id rank too; rows that repeat an id (or lack one) and its text
are one document and get one result; an empty table gives no rows; other columns pass through untouched, whatever their
names, but none may be named like spans_col.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import ship, stored

UNIT = "doc_id long, version int, pos int, digest long, line boolean"
SPANS = "array<struct<start:int,stop:int,words:int>>"
#: Multiplier of the digests, odd.
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Characters of the texts that are taken together.
TOGETHER = 1 << 20


class _Hashes(dict):
    """Hashes of words. Short words are remembered, up to a number of them."""

    def __missing__(self, word: str) -> int:
        value = xxh64_intdigest(word, 1)
        if len(word) <= 40:
            if len(self) >= 1 << 17:
                self.clear()
            self[word] = value
        return value


_hash_of = _Hashes().__getitem__


def _sizes(min_words: int) -> tuple[int, int]:
    """Words of a digest, and neighbouring digests of which the least is taken."""
    gram = (min_words + 2) // 2
    return gram, min_words - gram + 1


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one array, and each text's number of words."""
    words = [t.lower().split() if t else [] for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    return np.fromiter(map(_hash_of, chain.from_iterable(words)), np.uint64, int(n.sum())), n


def line_words_of(text: str | None) -> list[int]:
    """Numbers of words of a text's lines."""
    return [len(line.split()) for line in text.split("\n")] if text else []


def lines_of(texts: list[str | None], hashes: np.ndarray, line_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `hashes` where the lines of all texts begin that have line_words words at least, and their digests."""
    sizes = np.array([k for t in texts for k in line_words_of(t) if k], np.int64)
    if not len(sizes):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    starts = np.cumsum(sizes) - sizes
    powers = np.ones(int(sizes.max()), np.uint64)
    powers[1:] = ODD
    np.cumprod(powers, out=powers)
    digests = np.add.reduceat(hashes * powers[np.arange(len(hashes)) - np.repeat(starts, sizes)], starts)
    digests = (digests ^ (digests >> np.uint64(29))) * ODD + sizes.astype(np.uint64)
    own = sizes >= max(1, line_words)
    return starts[own], digests[own]


def _slide(values: np.ndarray, width: int, least_or_most: Callable) -> np.ndarray:
    have = 1
    while have < width:
        step = min(have, width - have)
        values = least_or_most(values[:-step], values[step:])
        have += step
    return values


def anchors_of(hashes: np.ndarray, n: np.ndarray, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in `hashes` of the anchors of all texts, in order, and their digests."""
    gram, window = _sizes(min_words)
    grams, windows = len(hashes) - gram + 1, len(hashes) - min_words + 1
    if windows <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    digests = np.zeros(grams, np.uint64)
    for k in range(gram):
        digests *= ODD
        digests += hashes[k : k + grams]
    np.maximum(digests, 1, out=digests)
    least = _slide(digests, window, np.minimum)
    stops = np.repeat(np.cumsum(n), n)
    least = np.where(np.arange(windows) + min_words <= stops[:windows], least, 0)  # none across two texts
    beside = np.zeros(window - 1, np.uint64)
    at = np.nonzero(_slide(np.concatenate([beside, least, beside]), window, np.maximum) == digests)[0]
    return at, digests[at]


def beside(hashes: np.ndarray, n: np.ndarray, at: np.ndarray, min_words: int) -> np.ndarray:
    """16 bits of the words before (outwards) and behind each anchor, window - 1 to a side; 0: none in its text."""
    gram, window = _sizes(min_words)
    tags = np.maximum((hashes >> np.uint64(48)).astype(np.uint16), 1)
    stops = np.cumsum(n)
    text = np.searchsorted(stops, at, "right")
    first, stop = (stops - n)[text][:, None], stops[text][:, None]
    k = np.arange(window - 1)
    where = np.concatenate([at[:, None] - 1 - k, at[:, None] + gram + k], axis=1)
    return np.where((where >= first) & (where < stop), tags[np.clip(where, 0, max(0, len(tags) - 1))], 0).astype("<u2")


def units_of(text: str | None, min_words: int = 30) -> tuple[list[int], list[int], list[int], list[int]]:
    """A text cut before its anchors: starts, stops (where the next unit starts), numbers of words and digests of the
    units' words."""
    hashes, n = word_hashes([text])
    if not len(hashes):
        return [], [], [], []
    cuts = [0, *(p for p in anchors_of(hashes, n, min_words)[0].tolist() if p), len(hashes)]
    offsets = _offsets(text)
    starts = [offsets[a] for a in cuts[:-1]]
    digests = [xxh64_intdigest(hashes[a:b].tobytes(), 1) for a, b in zip(cuts, cuts[1:])]
    return starts, [*starts[1:], len(text)], np.diff(cuts).tolist(), digests


def _offsets(text: str) -> list[int]:
    """Where each word starts; the first takes the white space before it. Behind the last: the text's end."""
    return [0, *[m.start() for m in re.finditer(r"\S+", text)][1:], len(text)]


def spans_of(text: str, pos: np.ndarray, near: np.ndarray, lines: np.ndarray, min_words: int) -> list[dict[str, int]]:
    """What to remove of a text whose lines at the words `lines` occurred earlier, and whose anchors at the words `pos`
    have a kept occurrence with `near` beside it."""
    if not len(pos):
        return _whole_lines(text, lines)
    gram, window = _sizes(min_words)
    hashes, n = word_hashes([text])
    same = (beside(hashes, n, pos, min_words) == near) & (near != 0)
    more = np.logical_and.accumulate(same.reshape(len(pos), 2, window - 1), axis=2).sum(axis=2)
    runs = [(a, b) for a, b in _joined(pos - more[:, 0], pos + gram + more[:, 1]) if b - a >= min_words]
    if not runs:
        return _whole_lines(text, lines)
    sizes = np.array([k for k in line_words_of(text) if k], np.int64)
    stops = np.cumsum(sizes)
    stop = stops[np.searchsorted(stops - sizes, lines)] if len(lines) else lines
    runs = _joined(np.array([*lines, *(a for a, _ in runs)], np.int64), np.array([*stop, *(b for _, b in runs)], np.int64))
    offsets = _offsets(text)
    return [{"start": offsets[a], "stop": offsets[b], "words": b - a} for a, b in runs]


def _whole_lines(text: str, lines: np.ndarray) -> list[dict[str, int]]:
    """What to remove where whole lines go and nothing else: no word needs its own offset."""
    wanted = set(lines.tolist())
    if not wanted:
        return []
    at, word, out, open_ = 0, 0, [], None
    for line in text.split("\n"):
        size = len(line.split())
        if size:
            start = at + len(line) - len(line.lstrip()) if word else 0
            if open_ is not None and word not in wanted:
                out.append({"start": open_[0], "stop": start, "words": word - open_[1]})
                open_ = None
            elif open_ is None and word in wanted:
                open_ = (start, word)
            word += size
        at += len(line) + 1
    if open_ is not None:
        out.append({"start": open_[0], "stop": len(text), "words": word - open_[1]})
    return out


def _joined(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """The ranges that (begin, end) cover together without a gap."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1]))
    return list(zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist()))


def _together(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= TOGETHER or i == len(texts) - 1:
            yield at, i + 1
            at, chars = i + 1, 0


def units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 30, line_words: int = 3, near: bool = False) -> DataFrame:
    """The lines and anchors (columns of UNIT) of all documents. version tells apart texts of one id; near, if asked for:
    what stands beside an anchor, nothing for a line."""
    ship(docs.sparkSession)
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    columns = UNIT + (", near binary" if near else "")
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])
    width = 4 * (_sizes(min_words)[1] - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _together(texts):
                hashes, n = word_hashes(texts[a:b])
                at, digests = anchors_of(hashes, n, min_words)
                begin, own = lines_of(texts[a:b], hashes, line_words)
                where = np.concatenate([at, begin])
                stops = np.cumsum(n)
                row = np.searchsorted(stops, where, "right")
                rows = pa.array(row + a)
                line = np.arange(len(where)) >= len(at)
                out = [batch.column(0).take(rows), batch.column(1).take(rows), pa.array((where - (stops - n)[row]).astype(np.int32)), pa.array(np.concatenate([digests, own]).view(np.int64)), pa.array(line)]
                if near:
                    offsets = np.minimum(np.arange(len(where) + 1), len(at)).astype(np.int32) * np.int32(width)
                    out.append(pa.Array.from_buffers(pa.binary(), len(where), [None, pa.py_buffer(offsets), pa.py_buffer(beside(hashes, n, at, min_words).tobytes())]))
                yield pa.RecordBatch.from_arrays(out, schema=schema)

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), _version(text_col).alias("version"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, columns)


def _version(text_col: str) -> Column:
    """31 bits of a text's hash: with its id they name a document."""
    return F.xxhash64(text_col).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")


def repeated_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 30, line_words: int = 3) -> DataFrame:
    """doc_id, version, found: pos, near (of the kept occurrence) and line of the units that occurred earlier, for the
    documents that have any."""
    how = {"min_words": min_words, "line_words": line_words}
    place = [F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("version"), F.col("pos")]
    # Combined before the shuffle: a unit that a third of the documents share is a row per task.
    first = units(docs, id_col, text_col, near=True, **how).groupBy("line", "digest").agg(F.min(F.struct(*place, "near")).alias("first"), F.count("*").alias("n"))
    first = stored(first.where("n > 1").select("line", "digest", "first"), "first")
    kept = F.col("first")
    later = F.struct(*(kept[c].alias(c) for c in ("no_id", "doc_id", "version", "pos"))) < F.struct(*place)
    rows = units(docs, id_col, text_col, **how).join(first, ["line", "digest"]).where(later)
    # A set: rows that repeat an id and its text have the same units.
    return rows.groupBy("doc_id", "version").agg(F.collect_set(F.struct("pos", kept["near"].alias("near"), "line")).alias("found"))


def _spans(min_words: int) -> Callable[[Column, Column], Column]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("words", pa.int32())]))

    @F.arrow_udf(SPANS)
    def spans(text: pa.Array, found: pa.Array) -> pa.Array:
        out: list[list | None] = [None] * len(found)
        for i in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)).tolist():
            own = found[i].values
            pos, line = own.field("pos").to_numpy().astype(np.int64), own.field("line").to_numpy(zero_copy_only=False)
            near = np.frombuffer(b"".join(own.field("near").to_pylist()), "<u2").reshape(int((~line).sum()), 2 * (_sizes(min_words)[1] - 1))
            out[i] = spans_of(text[i].as_py(), pos[~line], near, np.sort(pos[line]), min_words)
        return pa.array(out, kind)

    return spans


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_words: int = 30, line_words: int = 3, spans_col: str | None = "removed_spans") -> DataFrame:
    """docs with the repeated lines and passages cut from the text, and the original offsets of what was cut in spans_col.
    Rows travel as one struct, so their columns may have any names but that of spans_col."""
    if spans_col in docs.columns:
        raise ValueError(f"docs have a column {spans_col}; name another with spans_col")
    found = repeated_units(docs, id_col, text_col, min_words=min_words, line_words=line_words)
    found = found.select(F.col("doc_id").alias("found_id"), F.col("version").alias("found_version"), "found")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    own = docs.select(row, F.col(f"`{id_col}`").cast("long").alias("id"), _version(f"`{text_col}`").alias("version"))
    rows = own.join(found, F.col("id").eqNullSafe(F.col("found_id")) & (F.col("version") == F.col("found_version")), "left")
    text = F.col(f"row.`{text_col}`")
    rows = rows.withColumn("spans", _spans(min_words)(F.when(F.col("found").isNotNull(), text), F.col("found")))
    # What stays: from each span's end (or 0) to the next span's start (or the text's end).
    starts = F.concat(F.array(F.lit(0)), F.transform("spans", lambda s: s["stop"]))
    stops = F.concat(F.transform("spans", lambda s: s["start"]), F.array(F.length(text)))
    kept = F.array_join(F.zip_with(starts, stops, lambda a, b: F.substring(text, a + 1, b - a)), "")
    cut = F.when(F.col("spans").isNull(), text).otherwise(kept)
    extra = [F.coalesce("spans", F.expr(f"cast(array() as {SPANS})")).alias(spans_col)] if spans_col else []
    return rows.select(*(cut.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns), *extra)
