"""Dropping lines that many documents share, by a sharded perfect-hash index of line digests."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import ASCII_LOWER, kept, only, settle, ship, slices, texts
from quillmark.llm.perfect_hash import LineIndex

BLANK = b" \t\n\x0b\x0c\r"
NO_ID = -(2**63)
_LOADED: dict[str, dict[int, LineIndex]] = kept({})


def _digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit digest of the key of a line whose A-Z are lower-cased already; None for a key that is too short."""
    key = line.strip(BLANK)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _ids(batch: pa.RecordBatch, doc_id: str) -> list[int]:
    return [NO_ID if x is None else x for x in batch.column(batch.schema.get_field_index(doc_id)).to_pylist()]


def _words(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), ">u8").reshape(-1, 2).astype(np.uint64)


def _held(batches: Iterator[pa.RecordBatch], min_chars: int, row: str | None = None) -> Iterator[pa.RecordBatch]:
    """The digests of each document's lines with its id, and the row's number if asked."""
    for batch in slices(batches):
        digests, holders, rows = [], [], []
        numbers = batch.column(batch.schema.get_field_index(row)).to_pylist() if row else [0] * batch.num_rows
        for i, k, text in zip(_ids(batch, "doc_id"), numbers, texts(batch)):
            found = {_digest(x, min_chars) for x in text.translate(ASCII_LOWER).split(b"\n")} - {None}
            digests += found
            holders += [i] * len(found)
            rows += [k] * len(found)
        columns = [pa.array(digests, pa.binary()), pa.array(holders, pa.int64()), pa.array(rows, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns[: 3 if row else 2], ["digest", "holder", "row"][: 3 if row else 2])


def line_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shard_lines: int = 500_000) -> tuple[DataFrame, int]:
    """Shards ``(shard, index)`` over the digests of lines of at least ``min_chars`` found in ``min_docs`` documents, and their number.

    Documents are told apart by doc_id. Each document gives each of its digests once; counts are combined before each
    shuffle, so a line that every document holds costs a row for each task.
    """
    held = docs.select("doc_id", "text").mapInArrow(lambda b: _held(b, min_chars), "digest binary, holder long")
    shared = settle(held.groupBy("digest").agg(F.count_distinct("holder").alias("n"), F.max("holder").alias("last")).where(F.col("n") >= min_docs))
    shards = max(1, -(-shared.count() // shard_lines))

    def build(group: pa.Table) -> pa.Table:
        digests = _words(group.column("digest").to_pylist())
        index = LineIndex.build(digests, group.column("n").to_numpy().astype(np.int64), group.column("last").to_numpy().astype(np.int64))
        return pa.table({"shard": pa.array([group.column("shard")[0].as_py()], pa.int32()), "index": pa.array([index.dumps()], pa.binary())})

    placed = shared.withColumn("shard", _shard(F.col("digest"), shards))
    return settle(placed.groupBy("shard").applyInArrow(build, "shard int, index binary")), shards


def _shard(digest, shards: int):
    return F.pmod(F.crc32(digest), F.lit(shards)).cast("int")


def _shard_of(digests: list[bytes], shards: int) -> np.ndarray:
    import zlib

    return np.fromiter((zlib.crc32(x) % shards for x in digests), np.int64, len(digests)) if shards > 1 else np.zeros(len(digests), np.int64)


def _drops(digests: list[bytes], holders: np.ndarray, index: dict[int, LineIndex], shards: int) -> np.ndarray:
    """Whether each line goes: it is indexed, and its holder isn't the last."""
    out, words, at = np.zeros(len(digests), bool), _words(digests), _shard_of(digests, shards)
    for k in np.unique(at).tolist():
        if k in index:
            own = at == k
            n, last = index[k].find(words[own])
            out[own] = (n > 0) & (last != holders[own])
    return out


def _cleaned(batch: pa.RecordBatch, lines: list[list[bytes]], gone: list[list[bool]]) -> pa.RecordBatch:
    kept = [b"\n".join(x for x, g in zip(ls, gs) if not g).decode("utf-8", "replace") for ls, gs in zip(lines, gone)]
    columns = {f: batch.column(k) for k, f in enumerate(batch.schema.names)}
    columns["text"] = pa.array(kept, pa.string())
    columns |= {"n_lines": pa.array([len(x) for x in lines], pa.int64()), "n_dropped": pa.array([sum(x) for x in gone], pa.int64())}
    return pa.RecordBatch.from_pydict(columns)


def _with_counts(docs: DataFrame) -> tuple[DataFrame, T.StructType]:
    plain = docs.drop("n_lines", "n_dropped")
    return plain, T.StructType([*plain.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])


def drop_shared_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """``docs`` without the lines that ``min_docs`` or more documents share, but for the largest doc_id that holds each.

    A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased; keys under ``min_chars``
    code points always stay. All columns stay, ``text`` holds the kept lines, and ``n_lines`` and ``n_dropped`` are
    added in place of any columns of those names. A null or empty text is one empty line and becomes empty; rows that
    share a doc_id are one holder; null doc_ids count together as the smallest one. An empty table gives an empty one.

    The index is sent to all executors if its measured size is at most ``broadcast_bytes``; a larger one stays
    distributed, and the digests of the documents are dealt to its shards, salted, instead.
    """
    spark = docs.sparkSession
    ship(spark)
    index, shards = line_index(docs, min_chars, min_docs)
    size = index.agg(F.sum(F.length("index"))).first()[0] or 0
    if size > broadcast_bytes:
        return _routed(docs, index, shards, min_chars)
    sent = spark.sparkContext.broadcast([(r.shard, bytes(r["index"])) for r in index.collect()])
    name = uuid.uuid4().hex
    plain, schema = _with_counts(docs)

    def clean(batches):
        only(_LOADED)
        if name not in _LOADED:
            _LOADED.clear()
            _LOADED[name] = {k: LineIndex.loads(x) for k, x in sent.value}
        for batch in slices(batches):
            lines = [x.split(b"\n") for x in texts(batch)]
            found, holders, where = [], [], []
            for d, (i, ls) in enumerate(zip(_ids(batch, "doc_id"), lines)):
                for k, line in enumerate(ls):
                    if len(line) >= min_chars and (x := _digest(line.translate(ASCII_LOWER), min_chars)):
                        found.append(x)
                        holders.append(i)
                        where.append((d, k))
            gone = [[False] * len(ls) for ls in lines]
            for j in np.flatnonzero(_drops(found, np.array(holders, np.int64), _LOADED[name], shards)).tolist() if found else ():
                gone[where[j][0]][where[j][1]] = True
            yield _cleaned(batch, lines, gone)

    return plain.mapInArrow(clean, schema)


def _routed(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, task_lines: int = 200_000) -> DataFrame:
    """The same result with the index distributed: digests meet their shard's arrays, and each row gets its list of drops.

    The rows are numbered and written once, so a row's digests come back to it alone, whatever its doc_id is.
    """
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()))
    held = settle(rows.select("doc_id", "text", "__row").mapInArrow(lambda b: _held(b, min_chars, "__row"), "digest binary, holder long, row long"))
    salts = max(1, -(-held.count() // (shards * task_lines)))
    probes = held.withColumn("shard", _shard(F.col("digest"), shards)).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    copies = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probe(left, right):
        if not left.num_rows or not right.num_rows:
            return left.select(["digest", "row"]).slice(0, 0)
        n, last = LineIndex.loads(right.column("index")[0].as_py()).find(_words(left.column("digest").to_pylist()))
        return left.select(["digest", "row"]).filter(pa.array((n > 0) & (last != left.column("holder").to_numpy())))

    gone = probes.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(probe, "digest binary, row long")
    gone = gone.groupBy("row").agg(F.collect_set("digest").alias("__gone")).withColumnRenamed("row", "__row")
    plain, schema = _with_counts(docs)
    joined = rows.drop("n_lines", "n_dropped").join(gone, "__row", "left").select(*plain.columns, "__gone")

    def clean(batches):
        for batch in slices(batches):
            lines = [x.split(b"\n") for x in texts(batch)]
            lists = batch.column(batch.schema.get_field_index("__gone")).to_pylist()
            marked = [[len(x) >= min_chars and _digest(x.translate(ASCII_LOWER), min_chars) in (gone or ()) for x in ls] for ls, gone in zip(lines, map(set, (x or () for x in lists)))]
            yield _cleaned(batch.drop_columns(["__gone"]), lines, marked)

    return joined.mapInArrow(clean, schema)
