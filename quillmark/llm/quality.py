"""Document quality by Bradley-Terry ranking: scores learned from pairs of a better and a worse document."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import only, ship, slices, texts
from quillmark.llm.labelled import fit_logistic, sigmoid, training_sample

# Classes of bytes: 0 other, 1 lower case, 2 upper case, 3 digit, 4 white space, 5 sentence mark, 6 other mark, 7 beyond ASCII.
CLASSES = np.zeros(256, np.uint8)
CLASSES[97:123], CLASSES[65:91], CLASSES[48:58] = 1, 2, 3
CLASSES[[9, 10, 11, 12, 13, 32]] = 4
CLASSES[[ord(c) for c in ".,;:?!'\"-()"]] = 5
CLASSES[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 6
CLASSES[128:] = 7

FEATURES = (
    "log words", "mean word bytes", "spread of word bytes", "distinct words", "commonest word", "word repeats the last", "word of the last three",
    "upper case", "digits", "sentence marks", "other marks", "exclamations", "marks in a row", "words ending in marks", "words without letters", "words in upper case",
    "bytes beyond ASCII", "line breaks", "repeated lines", "sentence ends", "words of one letter", "longest word",
)


def features(text: bytes) -> list[float]:
    """Shares and sizes of the whole text, in the order of FEATURES; shares as square roots, so small ones count."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, np.uint8)
    kinds = CLASSES[raw]
    counts = np.bincount(kinds, minlength=8)
    solid = max(1, len(raw) - counts[4])
    letters = max(1, counts[1] + counts[2])
    marks = (kinds == 5) | (kinds == 6)
    blank = kinds == 4
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1])))
    ends = np.flatnonzero(~blank & np.concatenate((blank[1:], [True])))
    sizes = ends - starts + 1
    per_word = lambda mask: np.add.reduceat(mask, starts, dtype=np.int32)  # noqa: E731 (white space is in none of the masks)
    letter = (kinds == 1) | (kinds == 2) | (kinds == 7)
    lettered, upper = per_word(letter), per_word(kinds == 2)
    before = np.maximum(ends - 1, starts)
    doubled = marks[ends] & marks[before] & (ends > starts)
    commonest: dict[bytes, int] = {}
    for w in words:
        commonest[w] = commonest.get(w, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    near = sum(map(bytes.__eq__, words, words[2:])) + sum(map(bytes.__eq__, words, words[3:]))
    lines = [x for x in text.split(b"\n") if x.strip()]
    root = lambda a, b: float(np.sqrt(a / b))
    return [
        float(np.log1p(n)), float(sizes.mean()) / 10, float(sizes.std()) / 10, root(len(commonest), n), root(max(commonest.values()), n), root(again, n), root(near, 2 * n),
        root(counts[2], letters), root(counts[3], solid), root(counts[5], solid), root(counts[6], solid), root(int((raw == 33).sum()), solid), root(int((marks[1:] & marks[:-1]).sum()), solid),
        root(int(doubled.sum()), n), root(int((lettered == 0).sum()), n), root(int(((upper == lettered) & (lettered > 1)).sum()), n),
        root(counts[7], solid), root(text.count(b"\n"), n), root(len(lines) - len(set(lines)), max(1, len(lines))), root(int(np.isin(raw[ends], (33, 46, 63)).sum()), n), root(int((sizes == 1).sum()), n), float(np.log1p(sizes.max())),
    ]


@dataclass(frozen=True)
class RankingModel:
    """Linear scores of standardised features, and the line that turns them into 0 to 1: the cut's quantile gets ``at_cut``."""

    mean: list[float]
    scale: list[float]
    weights: list[float]
    cut: float
    slope: float
    at_cut: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - np.array(self.mean)) / np.array(self.scale), -6, 6)
        s = np.concatenate([z, z**2], 1) @ np.array(self.weights)
        return sigmoid((s - self.cut) * self.slope + np.log(self.at_cut / (1 - self.at_cut)))


def preference_pairs(y: np.ndarray, per_worse: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Indices (better, worse): every worse document against ``per_worse`` better ones, and every better one at least once."""
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return np.zeros(0, int), np.zeros(0, int)
    worse = np.concatenate([np.repeat(bad, per_worse), bad[rng.integers(0, len(bad), len(good))]])
    better = np.concatenate([good[rng.integers(0, len(good), len(bad) * per_worse)], good])
    return better, worse


def fit(x: np.ndarray, y: np.ndarray, at_cut: float = 0.7, per_worse: int = 20) -> RankingModel:
    """Logistic loss on differences of features over preference pairs. The cut is the quantile of the training scores that
    has the share of label 0 below it."""
    wide = len(FEATURES)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.5
        return RankingModel([0.0] * wide, [1.0] * wide, [0.0] * (2 * wide), 0.0, 1.0, min(max(share, 0.01), 0.99))
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -6, 6)
    z = np.concatenate([z, z**2], 1)
    better, worse = preference_pairs(y, per_worse)
    difference = z[better] - z[worse]
    weights = fit_logistic(difference, np.ones(len(difference)), ridge=1e-4)
    s = z @ weights
    order = np.argsort(s, kind="stable")
    quantile = int((y == 0).sum())
    low, high = s[order[max(0, quantile - 1)]], s[order[min(len(s) - 1, quantile)]]
    spread = float(np.subtract(*np.quantile(s, (0.9, 0.1)))) or 1.0
    return RankingModel(mean.tolist(), scale.tolist(), weights.tolist(), float((low + high) / 2), 4.0 / spread, at_cut)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 20_000) -> RankingModel:
    """A model from about ``most`` labelled documents outside the held-out fold. Only their features come to the driver."""
    ship(docs.sparkSession)
    rows = training_sample(docs, labels, label, most).select("doc_id", "text", "y").mapInArrow(_featured, "doc_id long, y int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in rows], np.float64).reshape(-1, len(FEATURES)), np.array([r.y for r in rows], np.int64))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only({})
    for batch in slices(batches):
        rows = [features(x) for x in texts(batch)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "y", "x"])


def score(docs: DataFrame, model: RankingModel, name: str = "score") -> DataFrame:
    """``docs`` with the column ``name``: 0 to 1, higher for better documents. It reads ``text`` only.

    A null or empty text has the features of a text without words. Repeated rows get one score each; a column of that
    name is replaced; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    plain = docs.drop(name)

    def run(batches):
        only({})
        for batch in slices(batches):
            x = np.array([features(t) for t in texts(batch)]).reshape(-1, len(FEATURES))
            columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | {name: pa.array(model.scores(x))})

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, model: RankingModel, least: float = 0.7) -> DataFrame:
    """The documents scored ``least`` or more, with the columns of ``docs``."""
    return score(docs, model, "__quality").where(F.col("__quality") >= least).drop("__quality")
