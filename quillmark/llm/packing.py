"""Packing token ids into windows of one size: bounded-space best fit within partitions, then merging of what is left."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import scratch, ship, slices, texts
from quillmark.llm.tokens import END_ID, default_tokenizer, encoder

PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
OUT = pa.schema([("level", pa.int32()), ("home", pa.int64()), ("window", pa.int64()), ("size", pa.int64()), ("pieces", pa.list_(PIECE)), ("closed", pa.bool_())])
OUT_DDL = "level int, home long, window long, size long, pieces array<struct<doc_id:long,start:long,length:long,doc_tokens:long,ids:binary>>, closed boolean"


class Packer:
    """At most ``space`` open windows. A piece goes where it fits best. When none has room and no more may be opened, the
    fullest is closed; with ``cut`` the piece's head fills it first, so that it closes without padding."""

    def __init__(self, size: int, space: int, close: Callable[[list], None], cut: bool = True):
        self.size, self.space, self.close, self.cut = size, space, close, cut
        self.open: list[list] = []  # [room, pieces]

    def add(self, piece: tuple) -> None:
        """piece: doc_id, start, length, doc_tokens, ids."""
        while True:
            n = piece[2]
            if n >= self.size:
                head, piece = self.split(piece, self.size)
                self.close([head])
                if piece is None:
                    return
                continue
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) < self.space:
                best = [self.size, []]
                self.open.append(best)
            if best is not None:
                best[1].append(piece)
                best[0] -= n
                if not best[0]:
                    self.open.remove(best)
                    self.close(best[1])
                return
            fullest = min(self.open, key=lambda w: w[0])
            self.open.remove(fullest)
            if self.cut:
                head, piece = self.split(piece, fullest[0])
                fullest[1].append(head)
            self.close(fullest[1])

    @staticmethod
    def split(piece: tuple, n: int) -> tuple[tuple, tuple | None]:
        d, start, length, total, ids = piece
        if n == length:
            return piece, None
        return (d, start, n, total, ids[: 4 * n]), (d, start + n, length - n, total, ids[4 * n :])


def _digested(pieces: list[tuple], keep_ids: bool) -> list[dict]:
    names = [f.name for f in PIECE]
    return [dict(zip(names, (*p[:4], p[4] if keep_ids else zlib.crc32(p[4]).to_bytes(4, "big")))) for p in pieces]


class _Rows:
    """Windows of one task, as batches: closed ones as they come, open ones at the end with their ids."""

    def __init__(self, level: int, home: int, keep_ids: bool):
        self.level, self.home, self.keep_ids, self.rows, self.n, self.held = level, home, keep_ids, [], 0, 0

    def put(self, pieces: list[tuple], closed: bool = True) -> None:
        kept = _digested(pieces, self.keep_ids or not closed)
        self.rows.append({"level": self.level, "home": self.home, "window": self.n, "size": sum(p[2] for p in pieces), "pieces": kept, "closed": closed})
        self.held += sum(len(p["ids"]) for p in kept) + 100 * len(kept)
        self.n += 1

    def batch(self) -> pa.RecordBatch:
        rows, self.rows, self.held = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, schema=OUT)


def _first(batches: Iterator[pa.RecordBatch], path: str, size: int, space: int, keep_ids: bool, cut: bool) -> Iterator[pa.RecordBatch]:
    rows = _Rows(0, TaskContext.get().partitionId(), keep_ids)
    packer, enc, end = Packer(size, space, rows.put, cut), encoder(path), np.array([END_ID], "<u4").tobytes()
    for batch in slices(batches, 4 << 20):
        for d, ids in zip(batch.column(0).to_pylist(), enc.encode(texts(batch), end)):
            packer.add((d, 0, len(ids) // 4, len(ids) // 4, ids))
        if rows.held > 8 << 20:
            yield rows.batch()
    for _, pieces in packer.open:
        rows.put(pieces, closed=False)
    yield rows.batch()


def _halves(n: int) -> list[int]:
    """The powers of two that make n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _merge(group: pa.Table, level: int, home: int, size: int, space: int, keep_ids: bool, cut: bool, last: bool) -> pa.Table:
    rows = _Rows(level, home, keep_ids)
    left = sorted(group.to_pylist(), key=lambda r: (-r["size"], r["home"], r["window"]))
    packer = Packer(size, space, rows.put, cut)
    for r in left:
        for p in r["pieces"]:
            packer.add((p["doc_id"], p["start"], p["length"], p["doc_tokens"], p["ids"]))
    if not last:
        for _, pieces in packer.open:
            rows.put(pieces, closed=False)
    elif not cut:
        for _, pieces in packer.open:
            rows.put(pieces)
    else:
        rest = [p for _, pieces in sorted(packer.open, key=lambda w: w[0]) for p in pieces]
        total = sum(p[2] for p in rest)
        for n in [size] * (total // size) + _halves(total % size):
            own = []
            while n:
                head, tail = Packer.split(rest[0], n) if rest[0][2] > n else (rest[0], None)
                own.append(head)
                n -= head[2]
                rest = ([tail] if tail else []) + rest[1:]
            rows.put(own)
    return pa.Table.from_batches([rows.batch()], schema=OUT)


def _merger(level: int, size: int, space: int, keep_ids: bool, cut: bool, last: bool) -> Callable:
    def merge(key, group):
        return _merge(group, level, key[0].as_py(), size, space, keep_ids, cut, last)

    return merge


def pack(docs: DataFrame, tokenizer: str | None = None, size: int = 4096, space: int = 4, fan_in: int = 64, keep_ids: bool = True, cut: bool = True) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids, doc_tokens, sequence_id, offset)`` of sequences of at most ``size`` ids.

    Every row of ``docs`` is a document: its text's ids (null: none) and the end id. A document of ``size`` ids or more
    gives whole sequences first. Each partition keeps ``space`` open windows. What partitions leave open, ``space``
    windows each, is merged ``fan_in`` partitions at a time until one group is left, which is cut to whole sequences and
    one sequence for each power of two in the rest, so none of them is padded. With ``cut=False`` documents under
    ``size`` stay whole and windows may be padded. Repeated rows are documents of their own; a null doc_id stays null;
    an empty table gives no pieces. With ``keep_ids=False``, ``ids`` holds the crc32 of a piece's ids (4 bytes, big-endian).

    Nothing is shuffled but the open windows. The windows are written once to the shared folder, so a task that runs
    again after a lost executor makes the same rows; at the end the ids in all windows are counted against those encoded.
    """
    spark = docs.sparkSession
    ship(spark)
    path = tokenizer or default_tokenizer()
    base = scratch(spark, "packed")
    source = docs.select("doc_id", "text")
    source.mapInArrow(lambda b: _first(b, path, size, space, keep_ids, cut), OUT_DDL).write.option("compression", "zstd").parquet(f"{base}/0")
    levels = [spark.read.parquet(f"{base}/0")]
    while True:
        level, left = len(levels), levels[-1].where("not closed")
        low, high = left.agg(F.min("home"), F.max("home")).first()
        if low is None:
            break
        merge = _merger(level, size, space, keep_ids, cut, low // fan_in == high // fan_in)
        left = left.withColumn("home", F.floor(F.col("home") / fan_in).cast("long"))
        left.groupBy("home").applyInArrow(merge, OUT_DDL).write.option("compression", "zstd").parquet(f"{base}/{level}")
        levels.append(spark.read.parquet(f"{base}/{level}"))
    whole = reduce(DataFrame.unionByName, levels)
    packed, given = whole.agg(F.sum(F.when(F.col("closed"), F.col("size"))), F.sum(F.when(F.col("level") == 0, F.col("size")))).first()
    if packed != given:
        raise RuntimeError(f"of {given} ids {packed} were packed")
    windows = whole.where("closed")
    number = F.expr("cast(level as long) * 72057594037927936 + home * 4294967296 + window").alias("sequence_id")
    before = F.expr("transform(pieces, (p, i) -> named_struct('p', p, 'offset', aggregate(slice(pieces, 1, i), 0L, (a, x) -> a + x.length)))")
    out = windows.select(number, F.explode(before).alias("x"))
    return out.select("x.p.doc_id", "x.p.start", "x.p.length", "x.p.ids", "x.p.doc_tokens", "sequence_id", "x.offset")
