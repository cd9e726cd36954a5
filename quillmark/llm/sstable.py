"""Sorted-string-table shards of token ids: prefix-compressed blocks, a sparse block index, a Bloom filter and a footer.

Layout of a shard, all numbers little-endian:

    blocks | index | Bloom filter | footer

A block is the crc32 of what follows, then zstd of its entries: varint bytes shared with the key before, varint bytes
not shared, varint bytes of the value, the key's rest, the value. The index has for each block its first key (as in the
entries), the place, the length, and the documents and ids before it in the shard. The Bloom filter has ten bits a key
and seven probes. The footer has the places and lengths of index and filter, the numbers of documents and ids, the width
of an id in bytes and the mark. A key is the id as eight big-endian bytes with the sign bit turned, so keys sort as ids;
a null id is the empty key, which sorts first. Documents with equal keys lie one behind another.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import ship, slices, texts
from quillmark.llm.tokens import END_ID, default_tokenizer, encoder

MARK = b"QMSST001"
FOOTER = struct.Struct("<QQQQQQQ8s")
INDEXED = struct.Struct("<QQQQ")
PROBES, BITS = 7, 10
MADE = "shard string, docs long, ids long"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = (h >> np.uint64(17)) | np.uint64(1)
    return ((h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    """Writes one shard to a stream; keys must come in order."""

    def __init__(self, out, width: int, block_bytes: int = 64 << 10):
        self.out, self.width, self.block_bytes = out, width, block_bytes
        self.at = self.docs = self.ids = 0
        self.index, self.keys, self.pack = [], [], zstandard.ZstdCompressor(level=1)
        self._start()

    def _start(self) -> None:
        self.entries, self.held, self.before, self.first = [], 0, b"", None

    def add(self, key: bytes, ids: bytes) -> None:
        """ids: little-endian 32-bit ids."""
        value = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        if self.first is None:
            self.first = (key, self.docs, self.ids)
        shared = 0
        while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
            shared += 1
        self.entries += [varint(shared), varint(len(key) - shared), varint(len(value)), key[shared:], value]
        self.before, self.held = key, self.held + len(value) + 12
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        self.docs, self.ids = self.docs + 1, self.ids + len(ids) // 4
        if self.held >= self.block_bytes:
            self._flush()

    def _write(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _flush(self) -> None:
        if self.entries:
            data, at = self.pack.compress(b"".join(self.entries)), self.at
            n = self._write(struct.pack("<I", zlib.crc32(data)) + data)
            key, docs, ids = self.first
            self.index.append(varint(len(key)) + key + INDEXED.pack(at, n, docs, ids))
            self._start()

    def close(self) -> None:
        self._flush()
        bits = max(64, -(-len(self.keys) * BITS // 64) * 64)
        mask = np.zeros(bits, bool)
        for i in range(0, len(self.keys), 100_000):
            mask[_probes(self.keys[i : i + 100_000], bits).ravel()] = True
        index, bloom = zlib.compress(b"".join(self.index)), np.packbits(mask, bitorder="little").tobytes()
        places = (self.at, len(index), self.at + len(index), len(bloom))
        self._write(index)
        self._write(bloom)
        self._write(FOOTER.pack(*places, self.docs, self.ids, self.width, MARK))


class ShardReader:
    """Reads a shard from a random-access file with ``read_at(n, place)`` and ``size()``."""

    def __init__(self, file):
        self.file = file
        end = file.size()
        a, n, b, m, self.docs, self.ids, self.width, mark = FOOTER.unpack(file.read_at(FOOTER.size, end - FOOTER.size))
        if mark != MARK:
            raise ValueError("not a shard of this format")
        data, at, self.firsts, self.blocks = zlib.decompress(file.read_at(n, a)), 0, [], []
        while at < len(data):
            k, at = read_varint(data, at)
            self.firsts.append(data[at : at + k])
            self.blocks.append(INDEXED.unpack_from(data, at + k))
            at += k + INDEXED.size
        self.bits, self.filter = m * 8, np.frombuffer(file.read_at(m, b), np.uint8)
        self.unpack = zstandard.ZstdDecompressor()

    def maybe(self, key: bytes) -> bool:
        at = _probes([key], self.bits)[0]
        return bool(((self.filter[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all())

    def block(self, k: int) -> Iterator[tuple[bytes, int, bytes]]:
        """Key, ids before it in the shard, and ids of each document of block k."""
        place, n, _, start = self.blocks[k]
        data = self.file.read_at(n, place)
        if zlib.crc32(data[4:]) != struct.unpack("<I", data[:4])[0]:
            raise ValueError(f"block {k} is damaged")
        data, at, key = self.unpack.decompress(data[4:]), 0, b""
        while at < len(data):
            shared, at = read_varint(data, at)
            rest, at = read_varint(data, at)
            size, at = read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            value = data[at + rest : at + rest + size]
            at += rest + size
            ids = value if self.width == 4 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            yield key, start, ids
            start += len(ids) // 4

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def get(self, doc_id: int | None) -> list[bytes]:
        """Ids of all documents of this id: the filter, a binary search of the index, then the blocks that may hold it."""
        key, out = key_of(doc_id), []
        if not self.firsts or not self.maybe(key):
            return out
        for k in range(max(0, bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[k] > key:
                break
            out += [ids for found, _, ids in self.block(k) if found == key]
        return out


def open_shard(uri: str) -> ShardReader:
    system, path = fs.FileSystem.from_uri(uri)
    return ShardReader(system.open_input_file(path))


def _written(batches: Iterator[pa.RecordBatch], uri: str, path: str, width: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    system, folder = fs.FileSystem.from_uri(uri)
    system.create_dir(folder, recursive=True)
    context = TaskContext.get()
    part, attempt = context.partitionId(), context.taskAttemptId()
    enc, end, made = encoder(path), np.array([END_ID], "<u4").tobytes(), []
    stream = shard = name = None

    def finish() -> None:
        shard.close()
        stream.close()
        system.move(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")
        made.append({"shard": name, "docs": shard.docs, "ids": shard.ids})

    for batch in slices(batches, 4 << 20):
        for d, ids in zip(batch.column(0).to_pylist(), enc.encode(texts(batch), end)):
            if shard is not None and shard.at >= shard_bytes:
                finish()
                shard = None
            if shard is None:
                name = f"{part:06d}-{len(made):06d}.sst"
                stream = system.open_output_stream(f"{folder}/.{name}.{attempt}")
                shard = ShardWriter(stream, width)
            shard.add(key_of(d), ids)
    if shard is not None:
        finish()
    yield pa.RecordBatch.from_pylist(made, schema=pa.schema([("shard", pa.string()), ("docs", pa.int64()), ("ids", pa.int64())]))


def write_shards(docs: DataFrame, uri: str, tokenizer: str | None = None, shard_bytes: int = 64 << 20) -> list[tuple[str, int, int, int]]:
    """Write the ids of every text as shards in ascending doc_id order under ``uri``; ``(shard, docs, ids, ids before)`` of each.

    Every row is a document: its text's ids (null: none) and the end id. Null doc_ids come first; rows that share a
    doc_id lie in the order of their texts. An empty table gives no shards. Rows are dealt by ranges of (doc_id, text),
    so no task holds more than its range. A shard appears under its name only when it is whole; a task that runs again
    writes the same bytes under the same name. ``uri`` must be a folder that all executors reach.
    """
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    width = 2 if encoder(path).library.get_vocab_size() <= 1 << 16 else 4
    ordered = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = ordered.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    made = ordered.mapInArrow(lambda b: _written(b, uri, path, width, shard_bytes), MADE).collect()
    out, before = [], 0
    for name, n, ids in sorted((r.shard, r.docs, r.ids) for r in made):
        out.append((name, n, ids, before))
        before += ids
    return out


def _read(batches: Iterator[pa.RecordBatch], uri: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader = open_shard(f"{uri}/{shard}")
            for k in range(0, len(reader.blocks), 32):
                rows = [x for j in range(k, min(k + 32, len(reader.blocks))) for x in reader.block(j)]
                ids = pa.array([x[2] for x in rows], pa.binary())
                starts = pa.array([base + x[1] for x in rows], pa.int64())
                counts = pa.array([len(x[2]) // 4 for x in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([id_of(x[0]) for x in rows], pa.int64()), starts, counts, ids], ["doc_id", "start", "n_tokens", "ids"])


def read_shards(spark: SparkSession, uri: str, shards: list[tuple[str, int, int, int]]) -> DataFrame:
    """Documents of the shards: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens`` and ``ids`` (little-endian, 32 bits each)."""
    ship(spark)
    listed = spark.createDataFrame([(s, before) for s, _, _, before in shards], "shard string, base long")
    return listed.repartition(max(1, len(shards))).mapInArrow(lambda b: _read(b, uri), "doc_id long, start long, n_tokens long, ids binary")


def lookup(spark: SparkSession, uri: str, shards: list[tuple[str, int, int, int]], doc_ids: list[int | None]) -> DataFrame:
    """``(doc_id, ids)`` of the named documents, by each shard's filter and index."""
    ship(spark)
    wanted = list(doc_ids)

    def find(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                reader = open_shard(f"{uri}/{shard}")
                rows = [(d, x) for d in wanted for x in reader.get(d)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in rows], pa.int64()), pa.array([x for _, x in rows], pa.binary())], ["doc_id", "ids"])

    listed = spark.createDataFrame([(s[0],) for s in shards], "shard string")
    return listed.repartition(max(1, len(shards))).mapInArrow(find, "doc_id long, ids binary")
