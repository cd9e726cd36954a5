"""Mixing sources to target weights: iterative proportional fitting of token weights, then sampling of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import only, scratch, ship, slices, texts, word_blocks

OTHER = "(other)"
NONE = "(none)"
TOPICS, TOPIC_WORD, BUCKETS = 8, 6, 256
LEAST = 0.25
MOST_SENT = 1_000_000  # cells; beyond, documents meet them in a join by name


def profile(blocks: Iterator[list[bytes]], known: dict[bytes, int]) -> tuple[int, bytes]:
    """How many words there are, and how many distinct long ones fall into each bucket, as roots in 255ths of the largest."""
    n, long = 0, set()
    for words in blocks:
        n += len(words)
        long.update(w for w in words if len(w) >= TOPIC_WORD)
    if len(known) > 300_000:
        known.clear()
    for w in long.difference(known):
        known[w] = zlib.crc32(w) % BUCKETS
    counts = np.sqrt(np.bincount(np.fromiter(map(known.__getitem__, long), np.int64, len(long)), minlength=BUCKETS))
    return n, np.rint(counts * (255 / max(counts.max(), 1))).astype(np.uint8).tobytes()


@dataclass(frozen=True)
class TopicModel:
    """Weights of buckets and unit centres of topics (spherical k-means)."""

    weights: np.ndarray
    centres: np.ndarray

    def unit(self, profiles: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(profiles), np.uint8).reshape(-1, BUCKETS) * self.weights
        return x / np.maximum(np.sqrt((x * x).sum(1)), 1e-300)[:, None]

    def topics(self, profiles: list[bytes]) -> np.ndarray:
        """Each profile's nearest centre, the first of equals."""
        return np.round(self.unit(profiles) @ self.centres.T, 9).argmax(1) if len(profiles) else np.zeros(0, np.int64)


def fit_topics(profiles: DataFrame, topics: int = TOPICS, rounds: int = 10) -> TopicModel:
    """Spherical k-means over the column ``profile`` of all rows; buckets weigh by how few documents have words in them.

    The first centres are profiles far from each other among 64 that a hash picks. Each round sums unit vectors, rounded
    to whole numbers so that the order of rows changes nothing, by topic and bucket; only these sums come to the driver.
    """

    def totals(rows):
        def run(batches):
            held = np.zeros((topics, BUCKETS), np.int64)
            for batch in slices(batches):
                held += rows(batch.column(0).to_pylist())
            at = np.flatnonzero(held.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held.ravel()[at])], ["at", "n"])

        out = np.zeros(topics * BUCKETS)
        for r in profiles.mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
            out[r["at"]] = r.n
        return out.reshape(topics, BUCKETS)

    def having(values):
        out = np.zeros((topics, BUCKETS), np.int64)
        out[0] = (np.frombuffer(b"".join(values), np.uint8).reshape(-1, BUCKETS) > 0).sum(0)
        return out

    n, df = profiles.count(), totals(having)[0]
    model = TopicModel(np.log((n + 1) / (df + 1)) + 1e-3, np.zeros((topics, BUCKETS)))
    some = profiles.distinct().orderBy(F.xxhash64("profile"), "profile").limit(64).collect()
    x = model.unit([bytes(r.profile) for r in some])
    x = x[x.any(1)]
    if not len(x):
        return model
    chosen = [0]
    while len(chosen) < min(topics, len(x)):
        chosen.append(int(np.round((x @ x[chosen].T).max(1), 9).argmin()))
    centres = np.zeros((topics, BUCKETS))
    centres[: len(chosen)] = x[chosen]
    for _ in range(rounds):
        model = TopicModel(model.weights, centres)

        def nearest(values, model=model):
            out, unit, at = np.zeros((topics, BUCKETS), np.int64), np.rint(model.unit(values) * 65536).astype(np.int64), model.topics(values)
            for k in np.unique(at).tolist():
                out[k] = unit[at == k].sum(0)
            return out

        sums = totals(nearest)
        size = np.sqrt((sums * sums).sum(1))
        new = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
        if np.abs(new - centres).max() < 1e-6:
            break
        centres = new
    return TopicModel(model.weights, centres)


def measured(docs: DataFrame, tokens: str = "n_tokens", topic: str = "topic", topics: int = TOPICS) -> DataFrame:
    """``docs`` with the number of words of the text, and with a topic name where the table brings no such column.

    Topics are clusters of vocabulary: distinct words of six bytes or more, lower-cased, fall into 256 buckets, and
    ``fit_topics`` clusters these profiles of all documents. A text without such words has the first topic. The texts
    are read once; the measured rows are written to the shared folder. A column ``n_tokens`` is replaced; a null or empty
    text has no words; repeated rows count each; an empty table gives an empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    own = docs.drop(tokens, "__profile")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only({})
        known: dict[bytes, int] = {}
        for batch in slices(batches):
            found = [profile(word_blocks(x), known) for x in texts(batch)]
            columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | {tokens: pa.array([n for n, _ in found], pa.int64()), "__profile": pa.array([p for _, p in found], pa.binary())})

    path = scratch(spark, "measured")
    fields = [*own.schema.fields, T.StructField(tokens, T.LongType()), T.StructField("__profile", T.BinaryType())]
    own.mapInArrow(run, T.StructType(fields)).write.option("compression", "zstd").parquet(path)
    sized = spark.read.parquet(path)
    if topic in docs.columns:
        return sized.drop("__profile")
    model = fit_topics(sized.select(F.col("__profile").alias("profile")), topics)

    @F.pandas_udf("string")
    def named(profiles: pd.Series) -> pd.Series:
        return pd.Series([f"topic{k}" for k in model.topics(profiles.tolist())], dtype=object)

    return sized.withColumn(topic, named("__profile")).drop("__profile")


@dataclass(frozen=True)
class Margin:
    """A column with the target share of each name (all others are one; shares sum to 1), or, without shares, the power to
    which the tokens of every name are raised to give its share: 1 leaves them, 0 makes them equal."""

    column: str
    shares: dict[str, float] | None = None
    power: float = 1.0


def tempered(totals: dict[str, float], power: float) -> dict[str, float]:
    """Target shares in proportion to each total's ``power``: 1 leaves them, 0 makes them equal."""
    raised = {k: v**power for k, v in totals.items() if v > 0}
    total = sum(raised.values())
    return {k: v / total for k, v in raised.items()}


def within(target: np.ndarray, supply: np.ndarray) -> np.ndarray:
    """Targets none of which is beyond its supply: what is goes to the others in proportion, as far as they can take it."""
    out, total = target.copy(), target.sum()
    for _ in range(len(target)):
        full = out >= supply
        out = np.where(full, supply, out)
        room, missing = out[~full].sum(), total - out.sum()
        if missing <= 1e-12 * total or room <= 0:
            break
        out[~full] *= 1 + missing / room
    return np.minimum(out, supply)


def rake(supply: np.ndarray, places: list[np.ndarray], targets: list[np.ndarray], budget: float, rounds: int = 500, close: float = 1e-9) -> np.ndarray:
    """Weights of cells, between a least weight and the cell's supply, whose margins meet the targets' shares of the budget.

    places[m][i] is cell i's category in margin m. Targets beyond a category's supply go to the others of its margin. Each
    round scales every margin in turn to its targets, no cell beyond its supply; a category that cannot be met stays at its
    supply while the others go on. Where the margins contradict each other, that would drive cells to 0: a cell has at
    least ``LEAST`` times its even share of the budget, lowered by each of its categories whose target is under theirs. So
    only cells of a category without a target have no weight.
    """
    even = budget / max(supply.sum(), 1e-300)
    w, floor, aims = supply * even, supply * even * LEAST, []
    for at, share in zip(places, targets):
        has = np.bincount(at, supply, minlength=len(share))
        aims.append(within(share * budget, has))
        floor = floor * np.minimum(1.0, aims[-1] / np.maximum(has * even, 1e-300))[at]
    for _ in range(rounds):
        before = w
        for at, aim in zip(places, aims):
            have = np.bincount(at, w, minlength=len(aim))
            free = np.bincount(at, np.where(w < supply, w, 0.0), minlength=len(aim))
            full = have - free
            factor = np.where(free > 0, np.maximum(aim - full, 0) / np.maximum(free, 1e-300), 1.0)
            grown = np.where(w < supply, w * factor[at], np.where(have[at] > aim[at], w * (aim[at] / np.maximum(have[at], 1e-300)), w))
            w = np.minimum(np.maximum(grown, floor), supply)
        if np.abs(w - before).max() <= close * max(1.0, budget):
            break
    return w


def _category(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(NONE))


def mix(docs: DataFrame, margins: list[Margin], keep: float, tokens: str = "n_tokens", doc_id: str = "doc_id", seed: int = 29) -> DataFrame:
    """``docs`` with ``probability`` and ``kept``: documents drawn so that expected tokens meet the margins.

    Token counts are summed by cell of the margins (a row for each combination of names that occurs reaches the driver,
    as numbers and a name for each category), raked to the targets with ``keep`` of all tokens as budget and no cell beyond what it has, and a document
    is kept with its cell's weight over its cell's tokens as probability. The draw is a hash of the id, the text's hash
    and the seed, so it is the same on every run and however rows are dealt; repeated rows are drawn alike. Nulls are a
    category; a category with no share is in the others, and has no share if the others have none. Documents without
    tokens have their cell's probability. Columns of the result's names are replaced. An empty table gives an empty one.
    """
    plain = docs.drop("probability", "kept")
    cells = [_category(m.column).alias(f"__m{k}") for k, m in enumerate(margins)]
    names = [f"__m{k}" for k in range(len(margins))]
    table = plain.select(*cells, F.col(tokens).alias("__n")).groupBy(*names).agg(F.sum("__n").cast("double").alias("n")).toArrow()
    if not table.num_rows:
        return plain.withColumn("probability", F.lit(0.0)).withColumn("kept", F.lit(False))
    table = table.sort_by([(n, "ascending") for n in names]).combine_chunks()
    supply = np.nan_to_num(table.column("n").to_numpy())
    places, targets = [], []
    for k, m in enumerate(margins):
        coded = pa.concat_arrays(table.column(k).chunks).dictionary_encode()
        every, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        shares = tempered(dict(zip(every, np.bincount(at, supply, minlength=len(every)).tolist())), m.power) if m.shares is None else m.shares
        found = [v if m.shares is None or v in shares else OTHER for v in every]
        order = sorted(set(found) | set(shares))
        place = {v: i for i, v in enumerate(order)}
        places.append(np.array([place[v] for v in found])[at])
        share = np.array([shares.get(v, 0.0) for v in order])
        present = np.bincount(places[-1], supply, minlength=len(order)) > 0
        share = np.where(present, share, 0.0)
        targets.append(share / share.sum() if share.sum() > 0 else np.where(present, 1 / max(1, present.sum()), 0.0))
    weights = rake(supply, places, targets, keep * supply.sum())
    chance = np.where(supply > 0, weights / np.maximum(supply, 1e-300), keep)
    known = docs.sparkSession.createDataFrame(table.select(names).append_column("probability", pa.array(chance, pa.float64())))
    known = F.broadcast(known) if table.num_rows <= MOST_SENT else known
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64("text") if "text" in plain.columns else F.lit(0)), 11) / F.lit(float(2**53))
    placed = plain
    for n, c in zip(names, cells):
        placed = placed.withColumn(n, c)
    return placed.join(known, names, "left").drop(*names).withColumn("kept", drawn < F.coalesce("probability", F.lit(0.0)))
