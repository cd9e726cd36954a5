"""Texts of an Arrow batch as flat arrays: code points, their classes, words and runs, so that a measurement is a few array
operations over a megabyte of text instead of an expression for each word."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa

SLICE = 1 << 18  # bytes of text that are worked on at once, so that they stay in a core's cache; a longer text is a slice of its own
LETTER, UPPER, DIGIT, NUMBER, BLANK, KEPT = 1, 2, 4, 8, 16, 32
_CLASSES: np.ndarray | None = None


def classes() -> np.ndarray:
    r"""For each code point, the sum of what it is: \p{L}, \p{Lu}, \p{Nd}, \p{N}, blank, or an ASCII letter, digit or apostrophe."""
    global _CLASSES
    if _CLASSES is None:
        kinds = {"Lu": LETTER | UPPER, "Ll": LETTER, "Lt": LETTER, "Lm": LETTER, "Lo": LETTER, "Nd": DIGIT | NUMBER, "Nl": NUMBER, "No": NUMBER}
        out = np.fromiter((kinds.get(unicodedata.category(chr(u)), 0) for u in range(0x110000)), np.uint8, 0x110000)
        out[[ord(c) for c in " \t\n\x0b\f\r"]] |= BLANK
        out[[u for u in range(128) if chr(u).isalnum() or chr(u) == "'"]] |= KEPT
        _CLASSES = out
    return _CLASSES


def table(characters: str) -> np.ndarray:
    """For each code point its place among the characters, counted from 1; 0 for all others."""
    out = np.zeros(0x110000, np.uint8)
    out[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
    return out


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, and where each begins, with the end. A null is an empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    if not len(texts) or texts.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def strings(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The strings that lie one behind the other in ``data``."""
    return pa.Array.from_buffers(pa.string(), len(bounds) - 1, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(data)])


def slices(texts: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of stretches of rows with about ``size`` bytes of text each."""
    bounds = raw(texts)[1]
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(bounds, bounds[at] + size, "right")) - 1)
        yield at, end
        at = end


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each sentence its text's row, its number within that text, and itself: the trimmed lines as ``text.sentences_of`` has them."""
    data, bounds = raw(texts)
    solid = np.flatnonzero(data > 0x20)
    stop = (data == 10) | (data == 13)
    stop[bounds[:-1][np.diff(bounds) > 0]] = True
    line = np.cumsum(stop, dtype=np.int32)[solid]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(solid)), bool), line[1:] != line[:-1])))
    starts = solid[new]
    ends = solid[np.append(new[1:], len(solid)) - 1] + 1 if len(new) else starts
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    row = np.searchsorted(bounds, starts, "right") - 1
    count = np.bincount(row, minlength=len(texts))
    place = np.arange(len(row)) - (np.cumsum(count) - count)[row]
    return row, place, strings(data[np.cumsum(inside, dtype=np.int8)[:-1] > 0], np.concatenate(([0], np.cumsum(ends - starts))))


class Words:
    """Strings cut from a text: the row of each, its bytes' place in ``data``, and the distinct ones with each string's number."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, owner: np.ndarray):
        self.data, self.starts, self.owner = data, starts, owner
        self.ends = np.append(starts[1:], len(data))
        self.sizes = self.ends - starts

    def __len__(self) -> int:
        return len(self.starts)

    @cached_property
    def array(self) -> pa.Array:
        return strings(self.data, np.append(self.starts, len(self.data)))

    @cached_property
    def coded(self) -> pa.DictionaryArray:
        return self.array.dictionary_encode()

    @cached_property
    def code(self) -> np.ndarray:
        return self.coded.indices.to_numpy().astype(np.int64)

    @property
    def distinct(self) -> pa.Array:
        return self.coded.dictionary

    def counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number of the distinct string, and how often the row has it; in the order of rows."""
        kinds = max(1, len(self.distinct))
        keys, n = np.unique(self.owner * kinds + self.code, return_counts=True)
        return keys // kinds, keys % kinds, n


class Text:
    """The characters of the texts, with plain apostrophes if asked. A null is an empty text."""

    def __init__(self, texts: pa.Array, plain: bool = True):
        self.n = len(texts)
        data, bounds = raw(texts)
        if len(data) and data.max() >= 0x80:
            self.codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
            self.starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[bounds]
        else:
            self.codes, self.starts = data.astype(np.uint32), bounds
        if plain:
            self.codes = np.where(self.codes == 0x2019, np.uint32(0x27), self.codes)
        self.sizes = np.diff(self.starts)

    @cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.sizes)

    @cached_property
    def kinds(self) -> np.ndarray:
        return classes()[self.codes]

    @cached_property
    def first(self) -> np.ndarray:
        """Of each character, whether it begins its text."""
        out = np.zeros(len(self.codes), bool)
        out[self.starts[:-1][self.sizes > 0]] = True
        return out

    def per_row(self, at: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """How many of the places, or of what they weigh, each text has."""
        return np.bincount(self.owner[at], weights, self.n)

    def count(self, chosen: np.ndarray) -> np.ndarray:
        """How many of the chosen characters each text has."""
        return np.diff(np.concatenate((np.zeros(1, np.int32), np.cumsum(chosen, dtype=np.int32)))[self.starts])

    def of(self, kind: int) -> np.ndarray:
        return (self.kinds & kind) != 0

    def heads(self, at: np.ndarray) -> np.ndarray:
        """The first of the ascending places within each text that has any."""
        row = self.owner[at]
        return at[np.concatenate((np.ones(min(1, len(at)), bool), row[1:] != row[:-1]))]

    def tails(self, at: np.ndarray) -> np.ndarray:
        row = self.owner[at]
        return at[np.concatenate((row[1:] != row[:-1], np.ones(min(1, len(at)), bool)))]

    def runs(self, at: np.ndarray, alike: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places where maximal runs of the ascending places ``at`` begin, and their lengths; of equal characters, if ``alike``."""
        if not len(at):
            return at, at
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | self.first[at[1:]]
        if alike:
            new[1:] |= self.codes[at[1:]] != self.codes[at[:-1]]
        begins = np.flatnonzero(new)
        return at[begins], np.diff(np.append(begins, len(at)))

    @cached_property
    def _blanks(self) -> np.ndarray:
        """Blanks before and at each character, and the beginnings of texts: it grows where a token may end."""
        return np.cumsum(self.of(BLANK) | self.first, dtype=np.int32)

    @cached_property
    def tokens(self) -> np.ndarray:
        """How many parts the blanks cut each text into; none, if it is empty."""
        return np.where(self.sizes > 0, 1 + self.per_row(self.runs(np.flatnonzero(self.of(BLANK)))[0]), 0)

    @property
    def solid_tokens(self) -> np.ndarray:
        """How many of these parts are not empty."""
        return self.per_row(self.runs(np.flatnonzero(~self.of(BLANK)))[0])

    def cut(self, kept: np.ndarray) -> Words:
        """The kept characters, which are ASCII, of each token; tokens without any are no words."""
        at = np.flatnonzero(kept)
        new = np.ones(len(at), bool)
        blanks = self._blanks[at]
        new[1:] = blanks[1:] != blanks[:-1]
        starts = np.flatnonzero(new)
        return Words(self.codes[at].astype(np.uint8), starts, self.owner[at[starts]])

    @cached_property
    def words(self) -> Words:
        return self.cut(self.of(KEPT))

    @cached_property
    def lower(self) -> Words:
        return lowered(self.words)


def lowered(words: Words) -> Words:
    data = words.data
    return Words(np.where((data >= 65) & (data <= 90), data | 0x20, data).astype(np.uint8), words.starts, words.owner)
