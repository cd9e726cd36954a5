"""What the operators of this package share: sessions, shared storage, batches of text, hashes, components."""

from __future__ import annotations

import atexit
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the executors, once for each application, so that workers import it wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="quillmark-")  # the driver serves it from there until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "quillmark_shipped.zip")
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, which ``spark.checkpoint.dir`` names.

    Where it is unset and everything runs in one process, that is a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isDefined():
        return set_dir.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="quillmark-"))
    return sc._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def discard(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and cut its lineage; the copy is in the shared folder, so a lost executor costs nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_residue(column: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus))


def crc32_of_id(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


_KEPT: list[dict] = []


def kept(cache: dict) -> dict:
    """Note a module's cache, which a worker keeps between tasks."""
    _KEPT.append(cache)
    return cache


def only(cache: dict) -> None:
    """Empty the caches of all other operators: a worker that goes from one to the next holds one cache at a time."""
    others = [x for x in _KEPT if x is not cache and x]
    for x in others:
        x.clear()
    if others:
        trim()


def trim() -> None:
    """Give freed memory back to the system, as far as the C library does that."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    return [x or b"" for x in values.cast(pa.binary()).to_pylist()]


ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lower_words(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased."""
    return text.translate(ASCII_LOWER).split()


_BLANK = re.compile(rb"[\x20\x09-\x0d]")


def word_blocks(text: bytes, limit: int = 1 << 20) -> Iterator[list[bytes]]:
    """The same words in turn, from about ``limit`` bytes of the text at a time; it is cut at white space. No list is empty."""
    at = 0
    while at < len(text):
        stop = _BLANK.search(text, at + limit)
        to = stop.start() if stop else len(text)
        if words := lower_words(text[at:to]):
            yield words
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose low bits depend on all bits (splitmix finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def binary_array(parts: list[bytes | None]) -> pa.Array:
    return pa.array(parts, pa.binary())


def in_pieces(table: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({f.name: pa.array(table[f.name], f.type) for f in schema}, schema=schema)


def slices(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most about ``limit`` bytes, one row at least."""
    for batch in batches:
        if batch.num_rows <= 1 or batch.nbytes <= limit:
            if batch.num_rows:
                yield batch
            continue
        step = max(1, int(batch.num_rows * limit / batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of the undirected ``edges(a, b)``: rows ``(id, component)``, the component's smallest id.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Each step is a grouped minimum, which is
    combined before its shuffle, and an equi-join that adaptive execution splits where a hub is hot. Null ends and
    loops take no part. Every round is settled in the shared folder.
    """
    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    for _ in range(rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").where("u != v").distinct()
        new = settle(small)
        totals = [x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first() for x in (e, new)]
        e = new
        if totals[0] == totals[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
