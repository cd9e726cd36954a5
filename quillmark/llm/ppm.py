"""Prediction by partial matching over bytes, pretrained on the corpus, with a unigram baseline over words."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.llm.common import kept, only, scratch, ship, slices, texts, trim, word_blocks

ORDER = 5
END = b"\n"
SLOTS = 1 << 20
BATCH = 1 << 20  # bytes of text; arrays of one batch take some sixty times as much
ALPHABET = 256


def stretches(text: bytes, order: int, limit: int = BATCH) -> Iterator[tuple[list[bytes], list[bytes]]]:
    """A text in turn, however long it is: some words, and what is complete of its normal form.

    The normal form is the words with A-Z lower-cased and single spaces between, and the end mark behind. It comes in
    stretches of ``limit`` bytes, the last one shorter, each behind the ``order`` bytes before it; before the first word
    stand end marks. The end mark is the last word.
    """
    held, begun = END * order, False
    for words in word_blocks(text, limit):
        held += b" " * begun + b" ".join(words)
        begun, out = True, []
        while len(held) > limit + order:
            out.append(held[: limit + order])
            held = held[limit:]
        yield words, out
    yield [END], [held + END]


def grams(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the stretches but the first ``order`` of each, in turn: the byte with the ``order`` bytes before it,
    as a number; and where each stretch's numbers begin."""
    raw = np.frombuffer(b"".join(parts), np.uint8)
    out = raw.astype(np.uint64)
    for k in range(1, order + 1):
        out[k:] |= raw[:-k].astype(np.uint64) << np.uint64(8 * k)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    starts = np.cumsum(sizes) - sizes
    own = np.ones(len(raw), bool)
    for k in range(order):
        own[starts + k] = False
    return out[own], starts - order * np.arange(len(parts))


def slot(x: np.ndarray, slots: int) -> np.ndarray:
    """A place from 0 to slots - 1, a power of two, for each number."""
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - slots.bit_length())).astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their counts' sums."""
    distinct, back = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(back, counts, minlength=len(distinct)).astype(np.int64)


class GramCounter:
    """Counts of 64-bit numbers in bounded space: the first number of each slot is counted there, and the others in sorted
    runs, which are merged when they are long and leave when there are too many."""

    def __init__(self, slots: int = SLOTS, most: int = 1_000_000):
        self.keys, self.counts, self.used = np.zeros(slots, np.uint64), np.zeros(slots, np.int64), np.zeros(slots, bool)
        self.runs, self.held, self.most = [], 0, most

    def add(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Count numbers; what leaves, if the runs got too long."""
        keys, counts = np.unique(x, return_counts=True)
        at = slot(keys, len(self.keys))
        free = ~self.used[at]
        self.keys[at[free]] = keys[free]  # of several for one slot the last stays
        self.used[at[free]] = True
        placed = self.keys[at] == keys
        self.counts[at[placed]] += counts[placed]
        self.runs.append((keys[~placed], counts[~placed]))
        self.held += len(self.runs[-1][0])
        if self.held <= self.most:
            return None
        keys, counts = self._merged()
        if len(keys) <= self.most // 2:
            self.runs, self.held = [(keys, counts)], len(keys)
            return None
        self.runs, self.held = [], 0
        return keys, counts

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.runs:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return summed(np.concatenate([k for k, _ in self.runs]), np.concatenate([c for _, c in self.runs]))

    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        full = self.counts > 0
        keys, counts = self._merged()
        return np.concatenate([self.keys[full], keys]), np.concatenate([self.counts[full], counts])


class Known:
    """Values of some numbers, and NaN for all others, looked up by slot first and by bisection for what isn't in its slot."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, slots: int = SLOTS):
        o = np.argsort(keys)
        self.keys, self.values = keys[o], values[o]
        at = slot(self.keys, slots)
        self.slots = np.full(slots, -1, np.int32)
        self.slots[at] = np.arange(len(at), dtype=np.int32)  # of several for one slot the last stays

    def find(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        if not len(self.keys):
            return out
        at = self.slots[slot(x, len(self.slots))]
        hit = (at >= 0) & (self.keys[at] == x)
        out[hit] = self.values[at[hit]]
        other = np.flatnonzero((at >= 0) & ~hit)  # an empty slot has no key
        at = np.minimum(np.searchsorted(self.keys, x[other]), len(self.keys) - 1)
        same = self.keys[at] == x[other]
        out[other[same]] = self.values[at[same]]
        return out


COUNTED = pa.schema([("word", pa.binary()), ("gram", pa.int64()), ("n", pa.int64())])


def _counted(batches: Iterator[pa.RecordBatch], order: int, most_words: int = 150_000) -> Iterator[pa.RecordBatch]:
    """Counts of words and of grams of ``order`` + 1 bytes in this partition, in parts."""
    only({})
    words: Counter[bytes] = Counter()
    counter, parts, held = GramCounter(), [], 0

    def of_words() -> pa.RecordBatch:
        n = len(words)
        return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.nulls(n, pa.int64()), pa.array(list(words.values()), pa.int64())], schema=COUNTED)

    def of_grams(found: tuple[np.ndarray, np.ndarray] | None) -> Iterator[pa.RecordBatch]:
        keys, counts = found or ((), ())
        for i in range(0, len(keys), 100_000):
            k, c = keys[i : i + 100_000], counts[i : i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(k), pa.binary()), pa.array(k.view(np.int64)), pa.array(c)], schema=COUNTED)

    for batch in slices(batches, BATCH):
        for text in texts(batch):
            for some, complete in stretches(text, order):
                words.update(some)
                parts += complete
                held += sum(map(len, complete))
                if len(words) > most_words:
                    yield of_words()
                    words.clear()
                if held > BATCH:
                    yield from of_grams(counter.add(grams(parts, order)[0]))
                    parts, held = [], 0
    if parts:
        yield from of_grams(counter.add(grams(parts, order)[0]))
    yield of_words()
    yield from of_grams(counter.rest())
    del counter, parts, words
    trim()


SCORED = "row long, n_tokens long, head_known long, head_score double, log double, tail array<binary>, rest array<long>, times array<long>"


def _scored(batches: Iterator[pa.RecordBatch], model, order: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows of two kinds: a document's columns, with its tokens and what the frequent words give the baseline; and of a
    document's stretches (``log`` is not null) the code length of the grams that were sent, its other grams with how often
    each comes, and its other words."""
    head, sent = model()
    look, first, n = head.__getitem__, TaskContext.get().partitionId() << 33, 0
    kinds = {"row": pa.int64(), "n_tokens": pa.int64(), "head_known": pa.int64(), "head_score": pa.float64(), "log": pa.float64(), "tail": pa.list_(pa.binary()), "rest": pa.list_(pa.int64()), "times": pa.list_(pa.int64())}

    def rows(like: pa.RecordBatch, columns: dict) -> pa.RecordBatch:
        size = len(columns["row"])
        other = {f.name: pa.nulls(size, f.type) for f in like.schema if f.name in names} | {k: pa.nulls(size, t) for k, t in kinds.items()}
        return pa.RecordBatch.from_pydict(other | columns)

    def solved(like: pa.RecordBatch, waiting: list[tuple[int, list[bytes], bytes]]) -> pa.RecordBatch:
        x, starts = grams([w[2] for w in waiting], order)
        logs = sent.find(x)
        unmet = np.isnan(logs)
        at = np.repeat(np.arange(len(waiting)), np.diff([*starts, len(x)]))[unmet]
        x = x[unmet]
        o = np.lexsort((x, at))
        x, at = x[o], at[o]
        new = np.flatnonzero(np.concatenate(([True], (x[1:] != x[:-1]) | (at[1:] != at[:-1]))[: len(x) + 1])) if len(x) else np.zeros(0, np.int64)
        offsets = pa.array(np.searchsorted(at[new], np.arange(len(waiting) + 1)).astype(np.int32))
        logs[unmet] = 0.0
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (x[new].view(np.int64), np.diff([*new, len(x)]).astype(np.int64))]
        return rows(like, {"row": pa.array([w[0] for w in waiting], pa.int64()), "log": pa.array(np.add.reduceat(logs, starts)), "tail": pa.array([w[1] for w in waiting], pa.list_(pa.binary())), "rest": lists[0], "times": lists[1]})

    for batch in slices(batches, BATCH):
        tokens, known, base, waiting, held = [], [], [], [], 0
        for k, text in enumerate(texts(batch)):
            sums, tail = [0, 0, 0.0], []
            for words, complete in stretches(text, order):
                v = np.fromiter(map(look, words), np.float64, len(words))
                other = np.isnan(v)
                tail += [words[i] for i in np.flatnonzero(other).tolist()]
                sums = [sums[0] + len(words), sums[1] + len(words) - int(other.sum()), sums[2] + float(v[~other].sum())]
                for part in complete:
                    waiting.append((first + n + k, tail, part))
                    tail, held = [], held + len(part)
                if held > BATCH:
                    yield solved(batch, waiting)
                    waiting, held = [], 0
            for column, x in zip((tokens, known, base), sums):
                column.append(x)
        if waiting:
            yield solved(batch, waiting)
        own = {f: batch.column(k) for k, f in enumerate(batch.schema.names) if f in names}
        yield rows(batch, own | {"row": pa.array(range(first + n, first + n + batch.num_rows), pa.int64()), "n_tokens": pa.array(tokens, pa.int64()), "head_known": pa.array(known, pa.int64()), "head_score": pa.array(base, pa.float64())})
        n += batch.num_rows


class _Head(dict):
    def __missing__(self, word: bytes) -> float:
        return float("nan")


_MODELS: dict[str, tuple[_Head, Known]] = kept({})


def _loader(sent, name: str):
    """The model of a broadcast, built once for each worker."""

    def load() -> tuple[_Head, Known]:
        only(_MODELS)
        if name not in _MODELS:
            _MODELS.clear()
            words, values, keys, logs = sent.value
            _MODELS[name] = _Head(zip(words.split(b" ") if words else [], values.tolist())), Known(keys, logs)
        return _MODELS[name]

    return load


def least_count(rows: DataFrame, most: int) -> int:
    """A count that at most ``most`` rows reach, from a histogram of sixteen ranges to each doubling of ``n``."""
    room = most
    for r in sorted(rows.groupBy(F.floor(F.log2("n") * 16).alias("size")).count().collect(), key=lambda r: -r["size"]):
        room -= r["count"]
        if room < 0:
            return int(np.floor(2 ** ((r["size"] + 1) / 16) - 1e-9)) + 1
    return 1


def _suffix(gram: str, size: str):
    """The last ``size`` bytes of a number of bytes."""
    return F.expr(f"CASE WHEN {size} >= 8 THEN {gram} ELSE {gram} & (shiftleft(1L, 8 * ({size})) - 1) END")


def levels(longest: DataFrame, order: int) -> DataFrame:
    """``(level, gram, n)``: of the counted grams of ``order`` + 1 bytes, the counts of their last bytes, for each level."""
    every = longest.select("gram", "n", F.lit(order).alias("level"))
    for j in range(order):
        every = every.unionByName(longest.groupBy(_suffix("gram", str(j + 1)).alias("gram")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(j)))
    return every


def contexts(nodes: DataFrame) -> DataFrame:
    """Of the pairs ``(level, gram, n)`` of a whole trie each context: ``total`` and ``kinds`` of what came after it, and
    ``rest_total`` and ``rest_kinds``, those of the context shorter by a byte without the symbols that came after this one.

    No key of these joins and groups has more than 256 rows, one for each byte.
    """
    shorter = nodes.select((F.col("level") + 1).alias("level"), F.col("gram").alias("suffix"), F.col("n").alias("shared"))
    each = nodes.withColumn("suffix", _suffix("gram", "level")).join(shorter, ["level", "suffix"], "left")
    each = each.groupBy("level", F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("shared").alias("shared"))
    up = each.select((F.col("level") + 1).alias("level"), F.col("context").alias("suffix"), F.col("total").alias("up_total"), F.col("kinds").alias("up_kinds"))
    joined = each.withColumn("suffix", F.when(F.col("level") > 0, _suffix("context", "level - 1"))).join(up, ["level", "suffix"], "left")
    return joined.select("level", "context", "total", "kinds", (F.col("up_total") - F.col("shared")).alias("rest_total"), (F.col("up_kinds") - F.col("kinds")).alias("rest_kinds"))


def _met(asked: DataFrame, table: DataFrame, key: str, low: int) -> DataFrame:
    """Rows with what the table has for their level and key: up to level ``low`` the table is sent out, as it is bounded there
    by the alphabet and its keys have very many rows, and above both sides meet in a join."""
    near, far = F.col("level") <= low, F.col("level") > low
    sent = asked.where(near).join(F.broadcast(table.where(near)), ["level", key], "left")
    return sent.unionByName(asked.where(far).join(table.where(far), ["level", key], "left"))


def walked(asked: DataFrame, nodes: DataFrame, held: DataFrame, order: int) -> DataFrame:
    """``(gram, value)`` of distinct grams: what ``Trie.walk`` gives with all ``nodes``, whose ``contexts`` are ``held``.

    The known contexts and the contexts after which the symbol came are each those up to a length. From the longest known
    one, each without the symbol escapes to the next, where the symbols of the longer one are excluded.
    """
    rows = asked.select("gram", F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")).withColumn("own", _suffix("gram", "level + 1"))
    rows = _met(rows, nodes.withColumnRenamed("gram", "own"), "own", 1).withColumn("context", F.shiftrightunsigned("own", 8))
    rows = _met(rows, held, "context", 2)
    passed = F.col("total").isNotNull() & F.col("n").isNull()
    open_ = passed & (F.col("rest_total") > 0)
    escape = F.when(open_, F.log10(0.5 * F.col("rest_kinds"))).otherwise(0.0)
    of = rows.groupBy("gram").agg(
        F.max(F.when(F.col("n").isNotNull(), F.col("level"))).alias("seen"), F.max(F.when(F.col("total").isNotNull(), F.col("level"))).alias("known"),
        F.min("n").alias("n"), F.min("total").alias("total"), F.min("kinds").alias("kinds"), F.max("kinds").alias("symbols"),
        F.sum(F.when(open_, escape - F.log10("rest_total")).otherwise(0.0)).alias("escapes"), F.min(F.when(passed, F.struct("level", escape.alias("log")))).alias("last"),
    )
    first = F.when(F.col("known").isNull(), 0.0).otherwise(F.when(F.col("seen").eqNullSafe(F.col("known")), 0.0).otherwise(F.log10(0.5 * F.col("kinds"))) - F.log10("total"))
    found = F.when(F.col("seen").isNotNull(), F.log10(F.col("n") - 0.5)).otherwise(-F.log10(F.greatest(F.lit(1), ALPHABET - F.coalesce("symbols", F.lit(0)))))
    return of.select("gram", (first + F.col("escapes") - F.coalesce("last.log", F.lit(0.0)) + found).alias("value"))


def score(docs: DataFrame, training=None, order: int = ORDER, head_grams: int = 500_000, head_words: int = 100_000) -> DataFrame:
    """``docs`` without ``text``, with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score``, all of whole texts.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. ``training`` is a condition on rows;
    all rows that meet it are counted (all rows, if it is None): every word, and every byte with its ``order`` bytes before.

    ``base_score`` is the sum over tokens of log10((c + 0.1) / (N + 0.1 (V + 1))). ``score`` is log10 of the trie's chance
    of the text's words with single spaces and an end. The trie has every counted pair of a context and a byte, whatever
    their number, and stays a table: a byte whose pair with its ``order`` bytes before was counted has its chance at that
    level, and all other bytes walk the trie's levels in joins (``walked``). Of the commonest pairs the chances, and of the
    commonest words (of at most 64 bytes) the counts are sent to the executors, ``head_grams`` and ``head_words`` at most;
    that saves joins and changes no result.

    A text is read in stretches of a megabyte, so what a worker holds doesn't grow with it. A null or empty text has one
    token, the end. Repeated rows count, and are scored, each. A null doc_id's row trains. Columns of the result's names,
    or named as the columns of SCORED, are replaced. Without training rows N and V are 0 and every byte is as likely. An
    empty table gives an empty one. The counted and the scored rows are written once to the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    base = scratch(spark, "ppm")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    plain = docs.drop("row", "n_tokens", "n_known", "head_known", "head_score", "log", "train_tokens", "base_score", "score", "tail", "rest", "times")
    learned = plain.where(training) if training is not None else plain
    counted = learned.select("text").mapInArrow(lambda b: _counted(b, order), "word binary, gram long, n long")
    counts = stored(counted.groupBy("word", "gram").agg(F.sum("n").alias("n")), "counts")
    words, longest = counts.where("word IS NOT NULL").select("word", "n"), counts.where("gram IS NOT NULL").select("gram", "n")
    total, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    chance = F.log10((F.col("n") - 0.5) / F.sum("n").over(Window.partitionBy(F.shiftrightunsigned("gram", 8))))
    pairs = stored(longest.select("gram", "n", chance.alias("value")), "pairs")
    top = pairs.where(F.col("n") >= least_count(pairs, head_grams)).select("gram", "value").toArrow()
    short = words.where(F.length("word") <= 64)
    frequent = short.where(F.col("n") >= least_count(short, head_words)).toArrow()
    scale = np.log10(total + 0.1 * (kinds + 1))
    values = np.log10(frequent.column("n").to_numpy().astype(np.float64) + 0.1) - scale
    sent = spark.sparkContext.broadcast((b" ".join(frequent.column("word").to_pylist()), values, top.column("gram").to_numpy().astype(np.int64).view(np.uint64), top.column("value").to_numpy().astype(np.float64)))
    del top, frequent
    load, own = _loader(sent, base), [f for f in plain.schema if f.name != "text"]
    out = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), SCORED])
    names = [f.name for f in own]
    scored = stored(plain.mapInArrow(lambda b: _scored(b, load, order, names), out), "scored")
    parts = scored.where("log IS NOT NULL")

    rest = parts.select("row", F.inline(F.arrays_zip("rest", "times"))).toDF("row", "gram", "times")
    met = stored(rest.join(pairs.select("gram", "value"), "gram", "left"), "met")
    asked = stored(met.where("value IS NULL").select("gram").distinct(), "asked")
    nodes = stored(levels(pairs.select("gram", "n"), order), "nodes")
    found = met.where("value IS NULL").drop("value").join(walked(asked, nodes, stored(contexts(nodes), "contexts"), order), "gram")
    logs = parts.select("row", F.col("log").alias("value"), F.lit(1).alias("times")).unionByName(met.where("value IS NOT NULL").drop("gram")).unionByName(found.drop("gram"))
    logs = logs.groupBy("row").agg(F.sum(F.col("value") * F.col("times")).alias("score"))
    tail = parts.select("row", F.explode("tail").alias("word")).join(words, "word", "left")
    tail = tail.groupBy("row").agg(F.count("n").alias("tail_known"), F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.1)) - F.lit(float(scale))).alias("tail_score"))
    joined = scored.where("log IS NULL").drop("log", "tail", "rest", "times").join(logs, "row", "left").join(tail, "row", "left")
    return joined.select(
        *names, "n_tokens", (F.col("head_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("head_score") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), "score",
    )
