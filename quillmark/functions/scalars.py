"""Measurements of one sentence, by group, over Arrow batches, and the columns of a prepared sentence that other parts read."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions import flat
from quillmark.functions import text as X
from quillmark.functions.lexicon import FUNCTION_WORDS, MARKS, SENTENCE_STARTERS


def prepared(sentences: DataFrame, casing: str = "preserve") -> DataFrame:
    """``sentences`` with t (text with plain apostrophes), tokens, words, lower words, and the four denominators' counts."""
    s = sentences.withColumn("t", X.plain_apostrophes(X.cased(F.col("sentence"), casing)))
    s = s.withColumn("tokens", X.raw_tokens(F.col("t"))).withColumn("w", X.words_of(F.col("tokens")))
    return s.withColumn("lw", F.transform("w", F.lower)).withColumns({"n_words": F.size("tokens"), "n_chars": F.length("t"), "n_w": F.size("w")})


def per_token() -> Column:
    return F.greatest(F.col("n_words"), F.lit(1))


def word_parts(lower: Column, listed: tuple[str, ...]) -> Column:
    """The function words in a word: the word itself, or else what its contraction holds."""
    known = lambda x: x.isin(*listed)
    at = F.instr(lower, "'")
    stem = F.substring(lower, F.lit(1), F.length(lower) - 3)
    negated = F.when(stem == "ca", "can").when(stem == "wo", "will").when(stem == "sha", "shall").otherwise(stem)
    parts = F.when(lower.endswith("n't"), F.array(negated, F.lit("n't"))).otherwise(F.array(F.substring(lower, F.lit(1), at - 1), F.substring(lower, at, F.length(lower))))
    return F.when(known(lower), F.array(lower)).when(at > 1, F.filter(parts, known)).otherwise(F.array().cast("array<string>"))


LENGTHS = {"wl_1_2": (0, 2), "wl_3_4": (3, 4), "wl_5_6": (5, 6), "wl_7_8": (7, 8), "wl_9_10": (9, 10), "wl_11_plus": (11, 10**6)}
CHARACTERS = "".join(dict.fromkeys((*MARKS, *'“”«»‘–—―…')))
_PLACES = flat.table(CHARACTERS)
_ENDS, _CLOSERS, _OPENERS = flat.table(".!?…"), flat.table("\"'”’)] \t\n\f\r"), flat.table("\"“‘'-–—«")
_REPEATED, _SPACED, _GLUED, _VOWELS = flat.table("!?,;:"), flat.table(",.;:!?"), flat.table(",;!?"), flat.table("aeiouy")
_LISTED = pa.array(FUNCTION_WORDS)
Values = dict[str, np.ndarray]


class Measured(flat.Text):
    """A slice of sentences with the denominators and counts that several groups share."""

    def __init__(self, texts: pa.Array, frequent: pa.Array):
        super().__init__(texts)
        self.frequent = frequent

    @property
    def per_token(self) -> np.ndarray:
        return np.maximum(self.tokens, 1)

    @property
    def per_char(self) -> np.ndarray:
        return np.maximum(self.sizes, 1)

    @cached_property
    def n_w(self) -> np.ndarray:
        return np.bincount(self.words.owner, minlength=self.n)

    @property
    def per_word(self) -> np.ndarray:
        return np.maximum(self.n_w, 1)

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum over each sentence's words, in their order."""
        return np.bincount(self.words.owner, values, self.n)

    def within(self, words: flat.Words, chosen: np.ndarray) -> np.ndarray:
        """How many of the chosen bytes each word has."""
        return np.add.reduceat(chosen.astype(np.int64), words.starts) if len(words) else np.zeros(0, np.int64)

    @cached_property
    def seen(self) -> np.ndarray:
        """How often each sentence has each of CHARACTERS."""
        place = _PLACES[self.codes]
        at = np.flatnonzero(place)
        return np.bincount(self.owner[at] * len(CHARACTERS) + place[at] - 1, minlength=self.n * len(CHARACTERS)).reshape(self.n, len(CHARACTERS))

    def these(self, characters: str) -> np.ndarray:
        return self.seen[:, [CHARACTERS.index(c) for c in characters]].sum(1)

    @property
    def place(self) -> np.ndarray:
        """Each word's place in its sentence."""
        before = np.cumsum(self.n_w) - self.n_w
        return np.arange(len(self.words)) - before[self.words.owner]


def _length(s: Measured) -> Values:
    return {"log_word_count": np.log1p(s.tokens), "log_char_count": np.log1p(s.sizes)}


def _word_length(s: Measured) -> Values:
    bare = s.words.sizes - s.within(s.words, s.words.data == 39)
    mean = s.total(bare) / s.per_word
    spread = np.sqrt(np.maximum(0.0, s.total(bare * bare) / s.per_word - mean * mean))
    return {"avg_word_length": s.count(s.of(flat.LETTER)) / s.per_token, "word_length_std": spread} | {k: s.total((bare >= a) & (bare <= b)) / s.per_word for k, (a, b) in LENGTHS.items()}


def _diversity(s: Measured) -> Values:
    row, _, c = s.lower.counts()
    add = lambda values: np.bincount(row, values, s.n)
    n, some = s.n_w.astype(float), s.n_w > 0
    return {
        "type_token_ratio": add(np.ones(len(c))) / s.per_word, "hapax_ratio": add(c == 1) / s.per_word,
        "simpson_d": np.where(n < 2, 0.0, 1 - add(c * (c - 1)) / (n * np.maximum(n - 1, 1) + (n == 0))), "yule_k": np.where(some, 10000.0 * (add(c * c) - n) / (n * n + ~some), 0.0),
    }


def syllables(words: pa.Array) -> np.ndarray:
    """Of lower-case ASCII words, as ``text.syllables`` has them."""
    raw, bounds = flat.raw(words)
    kept = raw != 39
    data = raw[kept]
    starts = np.concatenate(([0], np.cumsum(kept)))[bounds]
    size = np.diff(starts)
    begins = np.zeros(len(data), bool)
    begins[starts[:-1][size > 0]] = True
    vowel = (_VOWELS[data] > 0) & ~(begins & (data == 121))
    new = vowel.copy()
    new[1:] &= ~vowel[:-1] | begins[1:]
    groups = np.diff(np.concatenate(([0], np.cumsum(new)))[starts])

    def last(k: int) -> np.ndarray:
        """The k-th character from the end, 0 in shorter words."""
        return np.where(size >= k, data[np.maximum(starts[1:] - k, 0)], 0) if len(data) else np.zeros(len(size), np.uint8)

    def other(x: np.ndarray, than: bytes) -> np.ndarray:
        return (x > 0) & ~np.isin(x, list(than))

    silent = (groups > 1) & (last(1) == 101) & other(last(2), b"aeioul") & (size > 2)
    left = groups - silent
    ending = (left > 1) & (last(1) == 100) & (last(2) == 101) & other(last(3), b"aeioutd") & (size > 3)
    return np.where(size == 0, 0, np.maximum(left - ending, 1))


def _readability(s: Measured) -> Values:
    each = syllables(s.lower.distinct)[s.lower.code]
    mean, hard, some = s.total(each) / s.per_word, s.total(each >= 3) / s.per_word, s.n_w > 0
    return {
        "flesch_reading_ease": np.where(some, 206.835 - 1.015 * s.n_w - 84.6 * mean, 0.0), "gunning_fog": np.where(some, 0.4 * (s.n_w + 100.0 * hard), 0.0),
        "flesch_kincaid_grade": np.where(some, 0.39 * s.n_w + 11.8 * mean - 15.59, 0.0),
    }


def _punctuation(s: Measured) -> Values:
    own = s.seen[:, [CHARACTERS.index(m) for m in MARKS]]
    return {"punctuation_density": own.sum(1) / s.per_char, "punctuation_variety": (own > 0).sum(1) / len(MARKS)}


def _marks(s: Measured) -> Values:
    begin, length = s.runs(np.flatnonzero(s.codes == 46))
    alike, times = s.runs(np.flatnonzero(_REPEATED[s.codes]), alike=True)
    counts = {
        "comma_rate": s.these(","), "period_rate": s.per_row(begin[length == 1]), "semicolon_rate": s.these(";"), "colon_rate": s.these(":"), "exclamation_rate": s.these("!"), "question_rate": s.these("?"),
        "quote_rate": s.these('"“”«»'), "apostrophe_rate": s.these("'‘"), "bracket_rate": s.these("()[]{}"), "dash_rate": s.these("-–—―"), "ellipsis_rate": s.per_row(begin[length > 1]) + s.these("…"),
        "repeated_punct_rate": s.per_row(alike[times > 1]),
    }
    return {k: n / s.per_token for k, n in counts.items()}


def _orthography(s: Measured) -> Values:
    w = s.words
    capital = (w.data >= 65) & (w.data <= 90)
    letter = capital | ((w.data >= 97) & (w.data <= 122))
    capitals, letters = s.within(w, capital), s.within(w, letter)
    low = s.lower.data
    triple = np.zeros(len(low), bool)
    if len(low) > 2:
        triple[2:] = letter[2:] & (low[2:] == low[1:-1]) & (low[2:] == low[:-2])
        triple[w.starts] = False
        triple[w.starts[w.sizes > 1] + 1] = False
    return {
        "digit_ratio": s.count(s.of(flat.DIGIT)) / s.per_char, "uppercase_ratio": s.count(s.of(flat.UPPER)) / s.per_char, "all_caps_word_ratio": s.total((letters >= 2) & (letters == capitals)) / s.per_word,
        "capitalized_word_ratio": s.total(capital[w.starts] & (s.place > 0)) / np.maximum(s.n_w - 1, 1), "non_ascii_ratio": s.count(s.codes >= 0x80) / s.per_char,
        "elongation_ratio": s.total(s.within(w, triple) > 0) / s.per_word,
    }


def _layout(s: Measured) -> Values:
    follows = ~s.first[1:]
    pairs = lambda a, b: s.per_row(np.flatnonzero(a[:-1] & b[1:] & follows))
    space, letter = s.codes == 32, s.of(flat.LETTER)
    begin, length = s.runs(np.flatnonzero(space))
    odd = s.per_row(begin, length - 1) + pairs(space, _SPACED[s.codes] > 0) + pairs(_GLUED[s.codes] > 0, letter)
    capital, terminal, dialogue, starter = (np.zeros(s.n) for _ in range(4))
    at = s.heads(np.flatnonzero(letter | s.of(flat.DIGIT)))
    capital[s.owner[at]] = s.of(flat.UPPER)[at]
    at = s.tails(np.flatnonzero(_CLOSERS[s.codes] == 0))
    terminal[s.owner[at]] = _ENDS[s.codes[at]] > 0
    some = s.sizes > 0
    dialogue[some] = _OPENERS[s.codes[s.starts[:-1][some]]] > 0
    known = pc.is_in(s.lower.distinct, pa.array(SENTENCE_STARTERS)).to_numpy(zero_copy_only=False)
    head = s.place == 0
    starter[s.words.owner[head]] = known[s.lower.code[head]]
    return {"starts_with_capital": capital, "ends_with_terminal": terminal, "starts_with_dialogue": dialogue, "spacing_anomaly_rate": odd / s.per_char, "starts_with_conjunction": starter}


def _contractions(s: Measured) -> Values:
    w = s.words
    mark = np.flatnonzero(w.data == 39)
    word, k = np.unique(np.searchsorted(w.starts, mark, "right") - 1, return_index=True)
    held = np.zeros(len(w), bool)
    held[word] = (mark[k] > w.starts[word]) & (mark[k] < w.ends[word] - 1)
    return {"contraction_ratio": s.total(held) / s.per_word}


def has_function_word(word: str) -> bool:
    """Whether a lower-case word is listed or a contraction of a listed word, as ``word_parts`` takes it apart."""
    at = word.find("'")
    if word in _FUNCTION or at < 1:
        return word in _FUNCTION
    stem = word[: len(word) - 3]
    return bool(_FUNCTION & ({{"ca": "can", "wo": "will", "sha": "shall"}.get(stem, stem), "n't"} if word.endswith("n't") else {word[:at], word[at:]}))


_FUNCTION = frozenset(FUNCTION_WORDS)


def _function(s: Measured) -> Values:
    distinct = s.lower.distinct
    known = pc.is_in(distinct, _LISTED).to_numpy(zero_copy_only=False).copy()
    for k in np.flatnonzero(pc.match_substring(distinct, "'").to_numpy(zero_copy_only=False)):
        known[k] = has_function_word(distinct[k].as_py())
    return {"function_word_ratio": s.total(known[s.lower.code]) / s.per_word}


def _frequency(s: Measured) -> Values:
    """Without a list, a word's class is that of rank 1."""
    rank = np.ones(len(s.lower.distinct))
    if len(s.frequent):
        rank = pc.fill_null(pc.index_in(s.lower.distinct, s.frequent), len(s.frequent)).to_numpy() + 1
    keys = flat.lowered(s.cut(s.of(flat.KEPT) & ~s.of(flat.DIGIT)))
    listed = pc.is_in(keys.distinct, s.frequent).to_numpy(zero_copy_only=False)[keys.code]
    return {"frequent_word_ratio": np.bincount(keys.owner, listed, s.n) / s.per_token, "avg_word_freq_class": s.total(np.log2(1.0 + rank)[s.lower.code]) / s.per_word}


def _counts(s: Measured) -> Values:
    return {"n_words": s.tokens.astype(float), "n_chars": s.sizes.astype(float), "n_w": s.n_w.astype(float)}


GROUPS: dict[str, Callable[[Measured], Values]] = {
    "length": _length, "word_length": _word_length, "diversity": _diversity, "readability": _readability, "punctuation": _punctuation, "marks": _marks, "orthography": _orthography, "layout": _layout,
    "contractions": _contractions, "function": _function,
}
MORE = {"frequency": _frequency, "counts": _counts}


def values(texts: pa.Array, groups: list[str], frequent: pa.Array) -> Values:
    """The named groups' scalars of the sentences of an Arrow array, slice by slice."""
    spans = list(flat.slices(texts)) or [(0, 0)]
    parts = []
    for a, b in spans:
        s = Measured(texts.slice(a, b - a), frequent)
        parts.append({k: v for g in groups for k, v in (GROUPS | MORE)[g](s).items()})
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def columns(sentences: DataFrame, groups: list[str], frequent: list[str], keep: tuple[str, ...], text: str = "t") -> DataFrame:
    """``keep`` and the named groups' scalars of the sentences in the column ``text``."""
    return _measured(sentences.select(*keep, F.col(text).alias("__measured")), groups, frequent, split=False)


def _measured(rows: DataFrame, groups: list[str], frequent: list[str], split: bool) -> DataFrame:
    """The scalars of the last column, which is left out: sentences, or whole texts, each of which gives a row for a sentence."""
    ranked = list(dict.fromkeys(frequent))
    kept = [*rows.schema.fields[:-1], *([T.StructField("sent_idx", T.IntegerType())] if split else [])]
    names = list(values(pa.array([""]), groups, pa.array(ranked, pa.string())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = pa.array(ranked, pa.string())
        for batch in batches:
            *keys, texts = batch.columns
            texts = texts.cast(pa.string())
            for a, b in flat.slices(texts):
                own, some = [k.slice(a, b - a) for k in keys], texts.slice(a, b - a)
                if split:
                    row, place, some = flat.sentences(some)
                    own = [*(k.take(pa.array(row)) for k in own), pa.array(place, pa.int32())]
                found = values(some, groups, listed)
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(np.asarray(found[k], float)) for k in names]], [*(f.name for f in kept), *names])

    return rows.mapInArrow(run, T.StructType([*kept, *[T.StructField(k, T.DoubleType()) for k in names]]))


def measured(sentences: DataFrame, groups: list[str] | None = None, casing: str = "preserve", frequent: list[str] | None = None, keep: tuple[str, ...] = ("doc_id", "sent_idx")) -> DataFrame:
    """The named groups' scalars of every sentence."""
    plain = sentences.withColumn("__plain", X.cased(F.col("sentence"), casing))
    return columns(plain, list(GROUPS) if groups is None else groups, frequent or [], keep, "__plain")


def of_documents(docs: DataFrame, groups: list[str] | None = None, casing: str = "preserve", frequent: list[str] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(keep..., sent_idx, the scalars)`` as ``measured`` has them of ``readers.sentences(docs)``; the batches' whole texts are split."""
    return _measured(docs.select(*keep, X.cased(F.col("text"), casing).alias("__measured")), list(GROUPS) if groups is None else groups, frequent or [], split=True)


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, n)``: how often the lower-case words of the texts occur, a row for each word of a stretch of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).cast(pa.string())
            for a, b in flat.slices(texts, 16 * flat.SLICE):
                words = flat.Text(flat.sentences(texts.slice(a, b - a))[2]).lower
                yield pa.RecordBatch.from_arrays([words.distinct, pa.array(np.bincount(words.code, minlength=len(words.distinct)), pa.int64())], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word string, n long")
