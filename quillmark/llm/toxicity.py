"""Toxic passages: maximum-scoring segments over token log-odds, and a document score from their extreme-value statistics."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import only, settle, ship, slices, texts
from quillmark.llm.labelled import fit_logistic, sigmoid, training_sample

WORD = re.compile(r"[^\W\d_]+")
SHORTEST, LONGEST = 3, 8  # of the stems that stand for words not learned
END = "$"
CUT = 0.3  # the score from which a text counts as toxic
# Candidates for what a token costs and for what a clean word's log-odds are multiplied by; the third fold decides.
SETTINGS = ((0.2, 1.0), (0.5, 0.5), (0.5, 1.0), (1.0, 0.5), (1.0, 1.0), (1.5, 0.5), (2.0, 0.25), (2.0, 1.0), (2.5, 0.25))


def stems(word: str) -> list[str]:
    """A word's features from general to special: its beginnings, then the whole word."""
    return [word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)] + [word + END]


@dataclass(frozen=True)
class ToxicityModel:
    """Log-odds of stems and words, the price of each token, extreme-value parameters and the final line."""

    odds: dict[str, float] = field(default_factory=dict)
    price: float = 0.05
    decay: float = 1.0
    rate: float = 0.05
    line: tuple[float, ...] = (0.0, 0.0, 0.0)

    def token(self, word: str) -> float:
        for k in reversed(stems(word)):
            if k in self.odds:
                return self.odds[k] - self.price
        return -self.price

    def evidence(self, segments: list[tuple[int, int, float]], n_tokens: int) -> tuple[float, float]:
        """Of all segments together: how improbable the best is, and the sum beyond what chance gives, both as logarithms.

        By extreme-value theory the best segment of a clean text of n tokens exceeds s with chance 1 - exp(-rate n e^(-decay s)).
        """
        if not segments:
            return 0.0, 0.0
        expected = [np.log(max(self.rate * n_tokens, 1e-9)) - self.decay * s for _, _, s in segments]
        beyond = sorted((-e for e in expected), reverse=True)
        return max(0.0, beyond[0]), float(sum(max(0.0, b) for b in beyond))

    def score(self, segments: list[tuple[int, int, float]], n_tokens: int) -> float:
        best, total = self.evidence(segments, n_tokens)
        a, b, c = self.line
        return float(sigmoid(np.array([a + b * np.log1p(best) + c * np.log1p(total)]))[0])


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments ``(first, end, score)``, disjoint, in order, in linear time (Ruzzo and Tompa 1999).

    Only positive scores start a candidate, so the scan visits those alone; the running sum carries the rest.
    """
    total = np.cumsum(scores)
    found: list[list] = []  # [first, end, sum before, sum at end, the candidate to look at next below]
    for i in np.flatnonzero(scores > 0).tolist():
        left, right = float(total[i] - scores[i]), float(total[i])
        first, end = i, i + 1
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([first, end, left, right, j])
                break
            first, left = found[j][0], found[j][2]
            j_next = found[j][4]
            del found[j:]
            j = j_next
    return [(a, b, r - le) for a, b, le, r, _ in found]


def _tokens(text: bytes) -> list[str]:
    return WORD.findall(text.decode("utf-8", "replace").lower())


def _scan(model: ToxicityModel, known: dict[str, float], words: list[str]) -> list[tuple[int, int, float]]:
    if len(known) > 300_000:
        known.clear()
    for w in set(words).difference(known):
        known[w] = model.token(w)
    return segments(np.fromiter(map(known.__getitem__, words), np.float64, len(words))) if words else []


def _counted(batches: Iterator[pa.RecordBatch], flush: int = 400_000) -> Iterator[pa.RecordBatch]:
    """Documents of each label that hold each stem, from this partition."""
    counts: dict[str, list[int]] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([v[1] for v in counts.values()], pa.int64()), pa.array([v[0] for v in counts.values()], pa.int64())], ["stem", "toxic", "clean"])

    for batch in slices(batches):
        for text, y in zip(texts(batch), batch.column(batch.schema.get_field_index("y")).to_pylist()):
            for s in {s for w in set(_tokens(text)) for s in stems(w)}:
                counts.setdefault(s, [0, 0])[y] += 1
            if len(counts) > flush:
                yield out()
                counts.clear()
    if counts:
        yield out()


def log_odds(rows: list[tuple[str, int, int]], toxic: int, clean: int, prior: float = 4.0, least_z: float = 4.0) -> dict[str, float]:
    """Log-odds of stems with Dirichlet priors: a stem's prior is its shorter stem's posterior, worth ``prior`` documents.

    Stems whose log-odds are under ``least_z`` deviations from none are left out: they carry chance, not evidence.
    """
    counts = {s: (t, c) for s, t, c in rows}
    share: dict[str, float] = {}
    base = (toxic + 0.5) / (toxic + clean + 1)
    out = {}
    for s in sorted(counts, key=lambda x: (len(x.rstrip(END)), x)):
        t, c = counts[s]
        word = s[:-1]
        parent = base
        for k in range(min(LONGEST, len(word)), SHORTEST - 1, -1):
            if word[:k] in share:
                parent = share[word[:k]]
                break
        share[s] = (t + prior * parent) / (t + c + prior)
        odds = np.log(share[s] / (1 - share[s])) - np.log(base / (1 - base))
        # the count's own deviation from the base rate, as a normal score
        z = (t - (t + c) * base) / np.sqrt((t + c) * base * (1 - base))
        if abs(z) >= least_z and abs(odds) > 0.5:
            out[s] = float(np.clip(odds, -2, 10))
    return out


def extreme_value_fit(best: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
    """Decay and rate of the law of clean texts' best segment: the exponential tail over half the positive bests, with a
    prior of one best of 1 for each of two texts, so that the fit exists where clean texts have no segments."""
    tail = np.concatenate([best[best > 0], np.ones(2)])
    decay = len(tail) / tail.sum()
    rate = len(tail) / max(1.0, float(lengths.sum()))
    return float(decay), float(rate)


def _scanned(candidates: list[ToxicityModel]):
    """Of each document the segments' scores under each candidate."""

    def run(batches):
        only({})
        known: list[dict[str, float]] = [{} for _ in candidates]
        for batch in slices(batches):
            rows = []
            for i, text, y in zip(batch.column(0).to_pylist(), texts(batch), batch.column(batch.schema.get_field_index("y")).to_pylist()):
                words = _tokens(text)
                rows.append({"doc_id": i, "y": y, "n": len(words), "scores": [[s for _, _, s in _scan(m, k, words)] for m, k in zip(candidates, known)]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("scores", pa.list_(pa.list_(pa.float64())))]))

    return run


def _calibrated(model: ToxicityModel, scores: list[list[float]], n: list[int], y: np.ndarray) -> tuple[ToxicityModel, tuple[int, float]]:
    """The model with its extreme-value law, from the clean texts, and its line; and how many texts the line puts wrong at
    ``CUT``, with its mean log loss."""
    quiet = y == 0
    decay, rate = extreme_value_fit(np.array([max([0.0, *s]) for s, q in zip(scores, quiet) if q]), np.array(n)[quiet])
    model = ToxicityModel(model.odds, model.price, decay, rate)
    x = np.array([(1.0, *np.log1p(model.evidence([(0, 0, v) for v in s], k))) for s, k in zip(scores, n)])
    w = fit_logistic(x, y, ridge=1e-5)
    p = np.clip(sigmoid(x @ w), 1e-9, 1 - 1e-9)
    return ToxicityModel(model.odds, model.price, decay, rate, tuple(float(v) for v in w)), (int(((p >= CUT) != y).sum()), float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 30_000) -> ToxicityModel:
    """A model from about ``most`` labelled documents outside the held-out fold.

    Two of the three training folds give the log-odds. The third gives the extreme-value law (from its clean documents)
    and the final line for each of SETTINGS, and the setting with the fewest texts on the wrong side of ``CUT``, so none
    of them is fitted to texts whose words were learned. Stems that deviate from the base rate come to the driver, whose
    number the sample bounds. Without labels of both kinds every score is the labels' share.
    """
    ship(docs.sparkSession)
    rows = settle(training_sample(docs, labels, label, most).select("doc_id", "text", "fold", "y"))
    sizes = {(r.learn, r.y): r.n for r in rows.groupBy((F.col("fold") != 3).alias("learn"), "y").agg(F.count("*").alias("n")).collect()}
    toxic, clean = sizes.get((True, 1), 0), sizes.get((True, 0), 0)
    if not toxic or not clean:
        share = (toxic + sizes.get((False, 1), 0) + 0.5) / (sum(sizes.values()) + 1)
        return ToxicityModel(line=(float(np.log(share / (1 - share))), 0.0, 0.0))
    learn = rows.where("fold <> 3").select("text", "y").mapInArrow(_counted, "stem string, toxic long, clean long")
    learn = learn.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic + clean >= 4")
    share = toxic / (toxic + clean)
    z = F.abs(F.col("toxic") - (F.col("toxic") + F.col("clean")) * share) / F.sqrt((F.col("toxic") + F.col("clean")) * (share * (1 - share)))
    found = learn.where(z >= 3.5).collect()
    odds = log_odds([(r.stem, r.toxic, r.clean) for r in found], toxic, clean)
    candidates = [ToxicityModel({k: v if v > 0 else v * part for k, v in odds.items()}, price) for price, part in SETTINGS]
    seen = rows.where("fold = 3").select("doc_id", "text", "y").mapInArrow(_scanned(candidates), "doc_id long, y int, n long, scores array<array<double>>").collect()
    seen.sort(key=lambda r: (r.doc_id, r.y, r.n))
    y = np.array([r.y for r in seen], np.float64)
    if not len(y) or y.min() == y.max():
        m = candidates[SETTINGS.index((1.0, 1.0))]
        return ToxicityModel(m.odds, m.price, line=(float(np.log(share / (1 - share))), 0.0, 2.0))
    fitted = [_calibrated(m, [r.scores[k] for r in seen], [r.n for r in seen], y) for k, m in enumerate(candidates)]
    return min(fitted, key=lambda x: x[1])[0]


def score(docs: DataFrame, model: ToxicityModel, name: str = "score", passages: str = "passages") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher for more toxic texts, and the significant passages.

    ``passages`` lists ``first`` and ``end`` (word numbers) and ``weight`` (log-odds above chance) of every segment that a
    clean text of that length would show with a chance under one half. Only ``text`` is read, the whole of it. A null
    or empty text has no segments; repeated rows get the same score; columns of these names are replaced.
    """
    ship(docs.sparkSession)
    plain = docs.drop(name, passages)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64()), ("weight", pa.float64())]))

    def run(batches):
        only({})
        known: dict[str, float] = {}
        m = sent.value
        for batch in slices(batches):
            scores, spans = [], []
            for text in texts(batch):
                words = _tokens(text)
                found = _scan(m, known, words)
                chance = np.log(max(m.rate * len(words), 1e-9))
                scores.append(m.score(found, len(words)))
                spans.append([{"first": a, "end": b, "weight": s - chance / m.decay} for a, b, s in found if chance - m.decay * s < np.log(np.log(2))])
            columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | {name: pa.array(scores, pa.float64()), passages: pa.array(spans, kind)})

    span = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("end", T.LongType()), T.StructField("weight", T.DoubleType())]))
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType()), T.StructField(passages, span)]))
