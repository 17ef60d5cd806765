"""Byte-level BPE encoding of Arrow text columns with the tokenizers library.

A byte-level BPE encodes each pre-token by itself, so a text's ids are the ids of its pre-tokens in order. Prose
repeats its words, so each worker keeps the ids of the pre-tokens it has met and asks the library only for new ones.
Texts that hold a string of the vocabulary's added tokens (such as its end-of-text mark) go to the library whole, as it
cuts them out before anything else.
"""

from __future__ import annotations

import os
import re
from itertools import chain
from unicodedata import category

import numpy as np

#: Pre-tokens a worker remembers before it starts afresh; bounds its memory, never changes a result.
CACHE_WORDS = 500_000
#: Characters that are looked up at once.
CHARS = 500_000

#: Latin-1's white space, and its letters and numbers by their Unicode category.
SPACES = r" \t\n\r\x0b\x0c\x85\xa0"
LETTERS = "".join(chr(c) for c in range(256) if category(chr(c))[0] == "L")
NUMBERS = "".join(chr(c) for c in range(256) if category(chr(c))[0] == "N")

_encoders: dict[str, "Encoder"] = {}


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str, words: int = CACHE_WORDS) -> "Encoder":
    """This worker's encoder for a vocabulary file, which remembers `words` pre-tokens."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    _encoders[path].most = words
    return _encoders[path]


class Words(dict):
    """Numbers pre-tokens in the order in which they are first asked for; `new` holds those since it was last emptied."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


def grown(a: np.ndarray, size: int) -> np.ndarray:
    """a, or a copy of at least twice its length that holds `size`."""
    return a if size <= len(a) else np.concatenate([a, np.zeros(max(len(a), size - len(a)), a.dtype)])


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself where it prints, else the next from U+0100."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Texts to arrays of ids, those of the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer

        self.whole = whole = Tokenizer.from_file(path)
        self.model, self.size = whole.model, whole.get_vocab_size()
        added = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.has_added = re.compile("|".join(map(re.escape, added))).search if added else lambda text: None
        self.find_any = regex.compile(public_tokenizers.PATTERN).findall
        # The same pattern for texts of Latin-1 alone, whose classes are bitmaps: twice as fast.
        self.find_latin = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+").findall
        self.letters = byte_letters()
        self.most = CACHE_WORDS
        self._reset()

    def _reset(self) -> None:
        self.index = Words()
        self.flat = np.zeros(1 << 18, np.uint32)
        self.ends = np.zeros(1 << 16, np.int32)

    def _learn(self) -> None:
        """The library's ids of the pre-tokens that were numbered since the last call."""
        words, self.index.new = self.index.new, []
        tokenize, letters = self.model.tokenize, self.letters
        rows = [[t.id for t in tokenize(w.encode("utf-8", "surrogatepass").decode("latin-1").translate(letters))] for w in words]
        n = len(self.index)
        first = n - len(words)
        self.ends = grown(self.ends, n + 1)
        self.ends[first + 1 : n + 1] = self.ends[first] + np.cumsum(np.fromiter(map(len, rows), np.int32, len(rows)))
        start, stop = int(self.ends[first]), int(self.ends[n])
        self.flat = grown(self.flat, stop)
        self.flat[start:stop] = np.fromiter(chain.from_iterable(rows), np.uint32, stop - start)

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.find_any(text)
        return self.find_latin(text)

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """For each text its ids (uint32), and end after them; a null text is empty."""
        out: list[np.ndarray] = []
        group: list[str] = []
        size = 0
        for text in texts:
            text = text or ""
            if self.has_added(text):
                ids = self.whole.encode(text, add_special_tokens=False).ids
                out += [*self._encode(group, end), np.array([*ids, end], np.uint32)]
                group, size = [], 0
                continue
            group.append(text)
            size += len(text)
            if size > CHARS:
                out += self._encode(group, end)
                group, size = [], 0
        return out + self._encode(group, end)

    def _encode(self, texts: list[str], end: int) -> list[np.ndarray]:
        if len(self.index) > self.most:
            self._reset()
        words = list(map(self.find, texts))
        n = np.fromiter(map(len, words), np.int64, len(words))
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(words)), np.int32, int(n.sum()))
        if self.index.new:
            self._learn()
        starts = self.ends[at]
        lengths = self.ends[at + 1] - starts
        stop = np.zeros(len(at) + 1, np.int64)
        np.cumsum(lengths, out=stop[1:])
        ids = self.flat[np.arange(stop[-1]) + np.repeat(starts - stop[:-1], lengths)]
        edges = stop[np.concatenate([[0], np.cumsum(n)])].tolist()
        tail = np.array([end], np.uint32)
        return [np.concatenate([ids[a:b], tail]) for a, b in zip(edges, edges[1:])]
