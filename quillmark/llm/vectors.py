"""What the vector operators share: clean vectors as bytes, matrices, pivots, distances."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

AT_ONCE = 4 << 20  # numbers of one matrix of distances


def usable(vector: str, nonzero: bool = False) -> Column:
    """Whether a vector is not null or empty and holds finite components only (not all zero, if asked)."""
    big = F.lit(float("inf"))
    fine = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < big))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0) if nonzero else fine, F.lit(False))


def component_type(df: DataFrame, column: str) -> str:
    """How a vector's components are kept: 32-bit floats as such, all other numbers as 64-bit ones."""
    return "float" if df.schema[column].dataType.simpleString() == "array<float>" else "double"


def kind(component: str) -> str:
    return "<f4" if component == "float" else "<f8"


def packed(rows: DataFrame, component: str, digest: bool = False) -> DataFrame:
    """``rows`` with the array column ``vector`` as bytes, and their 128-bit ``digest`` if asked; no vector holds a null."""
    width = np.dtype(kind(component)).itemsize
    fields = [T.StructField(f.name, T.BinaryType()) if f.name == "vector" else f for f in rows.schema] + [T.StructField("digest", T.BinaryType())] * digest

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("vector"))
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind(component))
            offsets = column.offsets.to_numpy()
            offsets = ((offsets - offsets[0]) * width).astype(np.int32)
            found = pa.Array.from_buffers(pa.binary(), len(column), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
            columns = {f: found if f == "vector" else batch.column(k) for k, f in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_pydict(columns | ({"digest": pa.array([xxhash.xxh3_128_digest(x) for x in found.to_pylist()], pa.binary())} if digest else {}))

    return rows.withColumn("vector", F.col("vector").cast(f"array<{component}>")).mapInArrow(run, T.StructType(fields))


def matrix(values: list[bytes], component: str) -> np.ndarray:
    """Rows of one width, as 64-bit numbers."""
    return np.frombuffer(b"".join(values), kind(component)).astype(np.float64).reshape(len(values), -1)


def commonest_width(counts: dict[int, int]) -> int:
    """The width of most vectors, the larger of equals."""
    return max(counts, key=lambda w: (counts[w], w))


def picked(df: DataFrame, number: int, key: str, *columns: str) -> DataFrame:
    """At most ``number`` rows with the smallest hashes of ``key``: a stated sample that doesn't depend on partitions."""
    return df.select(*columns).orderBy(F.xxhash64(F.lit(17), key), key, *columns).limit(number)


def squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances, rows of x by pivots."""
    return np.sqrt(np.maximum(squares(x)[:, None] + squares(pivots)[None] - 2 * (x @ pivots.T), 0))


def portions(batches: Iterator[pa.RecordBatch], pivots: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches so short that a matrix of rows by pivots stays bounded."""
    step = max(1, AT_ONCE // max(1, pivots))
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)
