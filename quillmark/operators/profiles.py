"""Profile blocks of sentences: hashed character and tag n-grams, and function words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.functions.hashing import alnum, buckets_of, gram_hashes, units_of
from quillmark.functions.lexicon import FUNCTION_WORDS
from quillmark.functions.scalars import word_parts

ROWS = 2000  # of a batch; their shares are held at once


def _with_profile(df: DataFrame, name: str, source: str, buckets: int, make) -> DataFrame:
    """``df`` with an array column of ``buckets`` shares. ``make`` gives, for all values of a batch at once, the row and the
    bucket of each thing counted, and each row's total."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                batch = whole.slice(i, ROWS)
                row, bucket, totals = make(batch.column(batch.schema.get_field_index(source)))
                counts = np.bincount(row * buckets + bucket, minlength=batch.num_rows * buckets).reshape(batch.num_rows, buckets)
                shares = counts / np.maximum(totals, 1)[:, None]
                offsets = pa.array(np.arange(0, batch.num_rows * buckets + 1, buckets), pa.int32())
                columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
                yield pa.RecordBatch.from_pydict(columns | {name: pa.ListArray.from_arrays(offsets, pa.array(shares.ravel()))})

    fields = [f for f in df.schema.fields if f.name != name]
    return df.drop(name).mapInArrow(run, T.StructType([*fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def char_profile(df: DataFrame, n: int = 3, buckets: int = 256, typed: bool = False, text: str = "sentence", name: str = "profile") -> DataFrame:
    """Shares of hashed character n-grams. typed keeps those with a mark or space, or at the edge of a word. A null text has none."""

    def make(column: pa.Array):
        parts = [units_of(x or "") for x in column.to_pylist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        units = np.concatenate([np.zeros(0, "<u2"), *parts])
        ends = np.repeat(np.cumsum(sizes), sizes)
        row = np.repeat(np.arange(len(parts)), sizes)
        at = np.arange(len(units))
        whole = at + n <= ends
        if typed and len(units):
            word = np.concatenate((alnum()[units], [False]))
            other = np.concatenate(([0], np.cumsum(~word)))
            first = at == (ends - sizes[row])
            last = at + n == ends
            stop = np.minimum(at + n, len(units))
            whole &= (other[stop] - other[at] > 0) | first | ~word[at - 1] | last | ~word[stop]
        at = at[whole]
        return row[at], buckets_of(gram_hashes(units, n)[at], buckets), np.bincount(row[at], minlength=len(parts))

    return _with_profile(df, name, text, buckets, make)


def tag_profile(df: DataFrame, n: int = 2, buckets: int = 128, tags: str = "tags", name: str = "profile", kinds: int = 15) -> DataFrame:
    """Of tag n-grams; for n = 1 the tags' own shares, else with marks for begin and end, each unit one more than its tag."""

    def make(column: pa.Array):
        rows = [[] if x is None else x for x in column.to_pylist()]
        if n == 1:
            own, row = np.array([t for r in rows for t in r], np.int64), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
            return row[own < buckets], own[own < buckets], np.array([len(r) for r in rows])
        units = np.array([u for r in rows for u in (kinds + 1, *(t + 1 for t in r), kinds + 2)], np.uint32)
        sizes = np.array([len(r) + 2 for r in rows], np.int64)
        row, at = np.repeat(np.arange(len(rows)), sizes), np.arange(len(units))
        at = at[at + n <= np.repeat(np.cumsum(sizes), sizes)]
        return row[at], buckets_of(gram_hashes(units, n)[at], buckets), np.bincount(row[at], minlength=len(rows))

    return _with_profile(df, name, tags, buckets, make)


def function_word_parts(listed: tuple[str, ...] = FUNCTION_WORDS) -> Column:
    """Of a prepared sentence: the listed words found, contractions split, and how many words it has."""
    return F.struct(F.flatten(F.transform("lw", lambda x: word_parts(x, listed))).alias("parts"), F.col("n_w").alias("n"))


def function_word_profile(df: DataFrame, listed: tuple[str, ...] = FUNCTION_WORDS, source: str = "__fw", name: str = "fw") -> DataFrame:
    """The share of each listed word among a sentence's words, a bucket each, from ``function_word_parts``."""
    place = {w: k for k, w in enumerate(listed)}

    def make(column: pa.Array):
        rows = column.to_pylist()
        return np.repeat(np.arange(len(rows)), [len(r["parts"]) for r in rows]), np.array([place[w] for r in rows for w in r["parts"]], np.int64), np.array([r["n"] for r in rows])

    return _with_profile(df, name, source, len(listed), make)


def function_words(prepared: DataFrame, *keys: str, listed: tuple[str, ...] = FUNCTION_WORDS) -> DataFrame:
    """``(keys, word, share)`` of the listed words found, contractions split; shares of the sentence's words."""
    parts = F.flatten(F.transform("lw", lambda x: word_parts(x, listed)))
    found = prepared.select(*keys, "n_w", F.explode(parts).alias("word"))
    return found.groupBy(*keys, "n_w", "word").agg(F.count("*").alias("n")).select(*keys, "word", (F.col("n") / F.col("n_w")).alias("share"))


def distances(p: Column, q: Column) -> dict[str, Column]:
    """Cosine, Jensen-Shannon distance, total variation and Jaccard of two profiles; (0, 1, 1, 0) if one is empty."""
    zipped = F.zip_with(p, q, lambda x, y: F.struct(x.alias("p"), y.alias("q")))
    add = lambda f: F.aggregate(zipped, F.lit(0.0), lambda a, z: a + f(z.p, z.q))
    log = lambda x, m: F.when(x > 0, 0.5 * x * F.log2(x / m)).otherwise(0.0)
    none = (add(lambda x, y: x) == 0) | (add(lambda x, y: y) == 0)
    divergence = add(lambda x, y: log(x, (x + y) / 2) + log(y, (x + y) / 2))
    both, either = add(lambda x, y: F.when((x > 0) & (y > 0), 1.0).otherwise(0.0)), add(lambda x, y: F.when((x > 0) | (y > 0), 1.0).otherwise(0.0))
    norms = F.sqrt(add(lambda x, y: x * x)) * F.sqrt(add(lambda x, y: y * y))
    return {
        "cosine": F.when(none, 0.0).otherwise(F.try_divide(add(lambda x, y: x * y), norms)),
        "js_distance": F.when(none, 1.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), divergence)))),
        "total_variation": F.when(none, 1.0).otherwise(F.least(F.lit(1.0), add(lambda x, y: F.abs(x - y)) / 2)),
        "jaccard": F.when(none, 0.0).otherwise(F.try_divide(both, either)),
    }
