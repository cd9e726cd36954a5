"""Numbers of a whole document that tell how hard its boundaries are: length, topic and style, in one pass over its row."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quillmark.functions import flat
from quillmark.functions.lexicon import FUNCTION_WORDS

NAMES = (
    "log_sentences", "mean_log_words", "std_log_words", "topic_mean", "topic_std", "topic_p10", "topic_p50", "topic_p90", "topic_centroid", "topic_all_pairs", "distinct_words", "repeated_words",
    "style_mean", "style_std", "style_p90", "style_centroid",
)
TOPICS, MOST_PAIRED, STYLES = 1024, 150, 12
_LETTERS = re.compile(r"[^\W\d_]+")
_BLANK = re.compile(r"[ \t\n\x0b\f\r]+")


def string_hash(word: str) -> int:
    """The JVM's 32-bit string hash, unsigned."""
    h = 0
    for unit in np.frombuffer(word.encode("utf-16-le", "surrogatepass"), "<u2").tolist():
        h = (31 * h + unit) & 0xFFFFFFFF
    return h


def topic_bucket(word: str) -> int:
    h = string_hash(word) * 0x9E3779B1 & 0xFFFFFFFF
    return ((h ^ (h >> 15)) & 0x7FFFFFFF) % TOPICS


def content_words(sentence: str) -> list[str]:
    return [w for w in _LETTERS.findall(sentence.lower()) if len(w) >= 3 and w not in FUNCTION_WORDS]


def topic_vector(words: list[str]) -> np.ndarray:
    out = np.zeros(TOPICS)
    for w, n in Counter(words).items():
        out[topic_bucket(w)] += n
    out = np.sqrt(out)
    norm = np.linalg.norm(out)
    return out / norm if norm else out


def style_vector(s: str) -> np.ndarray:
    words, chars = max(1, len([w for w in _BLANK.split(s) if w])), max(1, len(s))
    letters = [c for c in s if c.isalpha()]
    marks = sum(c in "!;,.?'\":()-—–…[]{}" for c in s)
    count = lambda kept: sum(c in kept for c in s)
    return np.array([
        np.log1p(words), np.log1p(len(s)), len(letters) / words, count(",") / words, 100 * count('"“”«»') / chars, 100 * count("'’‘") / chars, sum(c.isupper() for c in letters) / max(1, len(letters)),
        sum(c.isdigit() for c in s) / chars, marks / chars, count("!?") / words, float(s[-1:] in set(".!?\"”’'")), float(s[:1].isupper() or s[:1] in set("\"“‘'")),
    ])


def nearest_rank(values: np.ndarray, f: float) -> float:
    return float(np.sort(values)[int(np.floor(f * (len(values) - 1) + 0.5))]) if len(values) else 0.0


def document_numbers(sentences: list[str], mean: np.ndarray, std: np.ndarray) -> list[float]:
    """The sixteen numbers; with fewer than two sentences all but the first are 0. Mean cosine of all pairs of the first 150
    sentences comes from the squared length of their sum."""
    n, out = len(sentences), np.zeros(len(NAMES))
    out[0] = np.log1p(n)
    if n < 2:
        return out.tolist()
    logs = np.log1p([len([w for w in _BLANK.split(s) if w]) for s in sentences])
    words = [content_words(s) for s in sentences]
    topic = np.array([topic_vector(w) for w in words])
    near = (topic[1:] * topic[:-1]).sum(1)
    centre = topic.sum(0)
    norm = np.linalg.norm(centre)
    first = topic[:MOST_PAIRED]
    m = len(first)
    held = Counter(w for ws in words for w in set(ws))
    style = (np.array([style_vector(s) for s in sentences]) - mean) / std
    steps = np.abs(style[1:] - style[:-1]).mean(1)
    out[1:] = [
        logs.mean(), logs.std(), near.mean(), near.std(), nearest_rank(near, 0.1), nearest_rank(near, 0.5), nearest_rank(near, 0.9), float((topic @ centre / norm).mean()) if norm else 0.0,
        (first.sum(0) @ first.sum(0) - (first * first).sum()) / (m * (m - 1)), len(held) / max(1, sum(map(len, words))), sum(c > 1 for c in held.values()) / max(1, len(held)),
        steps.mean(), steps.std(), nearest_rank(steps, 0.9), float(np.abs(style - style.mean(0)).mean(1).mean()),
    ]
    return out.tolist()


class Batch:
    """The sentences of some documents, flat: what ``document_numbers`` and ``style_vector`` say, for all of them at once."""

    def __init__(self, texts: pa.Array):
        self.n = len(texts)
        self.doc, self.place, self.sentences = flat.sentences(texts)
        self.size = np.bincount(self.doc, minlength=self.n)

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, values, self.n)

    def styles(self) -> np.ndarray:
        """The style numbers, a row for each sentence."""
        parts = [_styles(self.sentences.slice(a, b - a)) for a, b in flat.slices(self.sentences)]
        return np.concatenate([np.zeros((0, STYLES)), *parts])

    def topics(self) -> tuple[np.ndarray, ...]:
        """Row, topic and share of the unit topic vectors; document and number of words, and of sentences, for each distinct word."""
        lower = pa.array("\n".join(self.sentences.to_pylist()).lower().split("\n") if len(self.sentences) else [], pa.string())
        found: list[np.ndarray] = []
        parts: list[pa.Array] = []
        for a, b in flat.slices(lower):
            row, words = _content(lower.slice(a, b - a))
            found.append(row + a)
            parts.append(words)
        row = np.concatenate([np.zeros(0, np.int64), *found])
        coded = pa.chunked_array(parts, pa.string()).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        code = coded.indices.to_numpy().astype(np.int64)
        kinds = max(1, len(coded.dictionary))
        key, n = np.unique(row * TOPICS + topic_buckets(coded.dictionary)[code], return_counts=True)
        at, topic = key // TOPICS, key % TOPICS
        share = np.sqrt(n) / np.sqrt(np.bincount(at, n, len(self.doc)))[at]
        own = np.unique(row * kinds + code)  # each word once a sentence
        held, times = np.unique(self.doc[own // kinds] * kinds + own % kinds, return_counts=True)
        return at, topic, share, np.bincount(self.doc[row], minlength=self.n), held // kinds, times

    def numbers(self, mean: np.ndarray, std: np.ndarray) -> np.ndarray:
        """A row of ``NAMES`` for each document."""
        out = np.zeros((self.n, len(NAMES)))
        out[:, 0] = np.log1p(self.size)
        many = self.size >= 2
        if not many.any():
            return out
        size, doc = np.maximum(self.size, 1), self.doc
        style = self.styles()
        logs, z = style[:, 0], (style - mean) / std
        at, topic, share, words, held, times = self.topics()
        key = at * TOPICS + topic
        before = np.searchsorted(key, key - TOPICS)
        hit = (key[np.minimum(before, len(key) - 1)] == key - TOPICS) if len(key) else np.zeros(0, bool)
        dots = np.bincount(at[hit], share[hit] * share[before[hit]], len(doc))
        follows = np.flatnonzero(self.place > 0)  # the second sentence of each pair
        steps = np.abs(z[follows] - z[follows - 1]).mean(1)
        pair_doc, gaps = doc[follows], np.maximum(size - 1, 1)

        def spread(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            m = np.bincount(owner, values, self.n) / n
            return m, np.sqrt(np.bincount(owner, (values - m[owner]) ** 2, self.n) / n)

        order_near, order_step = np.lexsort((dots[follows], pair_doc)), np.lexsort((steps, pair_doc))
        begin = np.cumsum(self.size - (self.size > 0)) - (self.size - (self.size > 0))

        def rank(values: np.ndarray, order: np.ndarray, f: float) -> np.ndarray:
            return values[order[begin[many] + np.floor(f * (gaps[many] - 1) + 0.5).astype(np.int64)]]

        total, inverse = np.unique(doc[at] * TOPICS + topic, return_inverse=True)
        centre = np.bincount(inverse, share, len(total))
        norm = np.sqrt(np.bincount(total // TOPICS, centre**2, self.n))
        toward = np.bincount(doc[at], share * centre[inverse], self.n)
        early = self.place[at] < MOST_PAIRED
        first = np.bincount(inverse[early], share[early], len(total))
        paired = np.minimum(size, MOST_PAIRED)
        all_pairs = np.bincount(total // TOPICS, first**2, self.n) - np.bincount(doc[at[early]], share[early] ** 2, self.n)
        distinct = np.bincount(held, minlength=self.n)
        middle = np.stack([self.per_doc(z[:, k]) for k in range(STYLES)], 1) / size[:, None]
        columns = [
            *spread(logs, doc, size), *spread(dots[follows], pair_doc, gaps), None, None, None, toward / np.where(norm > 0, norm, 1) / size, all_pairs / np.maximum(paired * (paired - 1), 1),
            distinct / np.maximum(words, 1), np.bincount(held, times > 1, self.n) / np.maximum(distinct, 1), *spread(steps, pair_doc, gaps), None, self.per_doc(np.abs(z - middle[doc]).mean(1)) / size,
        ]
        for k, c in enumerate(columns, 1):
            if c is not None:
                out[many, k] = c[many]
        for k, values, order, f in ((5, dots[follows], order_near, 0.1), (6, dots[follows], order_near, 0.5), (7, dots[follows], order_near, 0.9), (14, steps, order_step, 0.9)):
            out[many, k] = rank(values, order, f)
        return out


_WORD: np.ndarray | None = None
_ALPHA: np.ndarray | None = None
_MARKS = {k: flat.table(v) for k, v in {"comma": ",", "quote": '"“”«»', "apostrophe": "'’‘", "mark": "!;,.?'\":()-—–…[]{}", "loud": "!?", "end": ".!?\"”’'", "open": "\"“‘'"}.items()}


def topic_buckets(words: pa.Array) -> np.ndarray:
    """``topic_bucket`` of each of the words, which are not empty."""
    data, bounds = flat.raw(words)
    if not len(words):
        return np.zeros(0, np.int64)
    units = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-16-le"), "<u2").astype(np.uint32)
    starts = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80) + np.cumsum(data >= 0xF0)))[bounds]
    power = np.cumprod(np.concatenate(([1], np.full(int(np.diff(starts).max()), 31))).astype(np.uint32), dtype=np.uint32)
    left = np.repeat(starts[1:], np.diff(starts)) - 1 - np.arange(len(units))
    h = np.add.reduceat(units * power[left], starts[:-1], dtype=np.uint32) * np.uint32(0x9E3779B1)
    return (((h ^ (h >> np.uint32(15))) & np.uint32(0x7FFFFFFF)) % TOPICS).astype(np.int64)


def _letters() -> tuple[np.ndarray, np.ndarray]:
    r"""For each code point whether it is of [^\W\d_]; and the sum of 1: isalpha, 2: isupper, 4: isdigit."""
    global _WORD, _ALPHA
    if _WORD is None or _ALPHA is None:
        every = [chr(u) for u in range(0x110000)]
        _WORD = np.fromiter((c.isalnum() and not c.isdecimal() for c in every), bool, 0x110000)
        _ALPHA = np.fromiter((c.isalpha() + 2 * c.isupper() + 4 * c.isdigit() for c in every), np.uint8, 0x110000)
    return _WORD, _ALPHA


def _styles(sentences: pa.Array) -> np.ndarray:
    s = flat.Text(sentences, plain=False)
    kinds = _letters()[1][s.codes]
    words, chars = np.maximum(1, s.solid_tokens), np.maximum(1, s.sizes)
    alpha = kinds & 1 > 0
    letters = s.count(alpha)
    has = {k: t[s.codes] > 0 for k, t in _MARKS.items()}
    some = s.sizes > 0
    last, first = np.zeros(s.n), np.zeros(s.n)
    last[some] = has["end"][s.starts[1:][some] - 1]
    first[some] = (kinds & 2 > 0)[s.starts[:-1][some]] | has["open"][s.starts[:-1][some]]
    return np.column_stack([
        np.log1p(words), np.log1p(s.sizes), letters / words, s.count(has["comma"]) / words, 100 * s.count(has["quote"]) / chars, 100 * s.count(has["apostrophe"]) / chars,
        s.count(alpha & (kinds & 2 > 0)) / np.maximum(1, letters), s.count(kinds & 4 > 0) / chars, s.count(has["mark"]) / chars, s.count(has["loud"]) / words, last, first,
    ])


def _content(lower: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and text of each content word of lower-case sentences: runs of letters, three at least, no function words."""
    data, _ = flat.raw(lower)
    s = flat.Text(lower, plain=False)
    begin, length = s.runs(np.flatnonzero(_letters()[0][s.codes]))
    place = np.concatenate((np.flatnonzero((data & 0xC0) != 0x80), [len(data)]))  # of each character in the bytes
    enough = length >= 3
    begin, length = begin[enough], length[enough]
    starts, ends = place[begin], place[begin + length]
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1
    words = flat.strings(data[np.cumsum(inside, dtype=np.int8)[:-1] > 0], np.concatenate(([0], np.cumsum(ends - starts))))
    keep = pc.invert(pc.is_in(words, pa.array(FUNCTION_WORDS)))
    return s.owner[begin][keep.to_numpy(zero_copy_only=False)], words.filter(keep)


def style_scale(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the twelve style numbers over all sentences, summed by partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, q = 0, np.zeros(STYLES), np.zeros(STYLES)
        for batch in batches:
            for _, part in _parts(batch):
                x = part.styles()
                n, s, q = n + len(x), s + x.sum(0), q + (x * x).sum(0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.float64())), "q": pa.array([q.tolist()], pa.list_(pa.float64()))})

    rows = docs.select("doc_id", "text").mapInArrow(run, "n long, s array<double>, q array<double>").collect()
    n = max(1, sum(r.n for r in rows))
    mean = np.sum([r.s for r in rows], 0) / n if rows else np.zeros(STYLES)
    square = np.sum([r.q for r in rows], 0) / n if rows else np.ones(STYLES)
    return mean, np.sqrt(np.maximum(1e-12, square - mean**2))


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, Batch]]:
    """Ids and sentences of some documents of the batch at a time."""
    texts = batch.column(1).cast(pa.string())
    for a, b in flat.slices(texts, 4 * flat.SLICE):
        yield batch.column(0).slice(a, b - a), Batch(texts.slice(a, b - a))


def numbers(docs: DataFrame, scale: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """``(doc_id, the sixteen numbers)`` of every document; styles are scaled as given, or over these documents."""
    mean, std = scale or style_scale(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, part in _parts(batch):
                rows = part.numbers(mean, std)
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(NAMES))]], ["doc_id", *NAMES])

    return docs.select("doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} double" for n in NAMES)]))
