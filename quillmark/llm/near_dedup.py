"""Near-duplicate documents by word shingles: MinHash signatures, a multi-index Hamming join, and exact confirmation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import components, kept, mix64, only, scratch, ship, slices, texts, word_blocks

WORDS = 5  # of a shingle
CHUNKS, WIDTH = 8, 4  # the signature's 32 symbols of 16 bits; a chunk may have one error
SYMBOLS = CHUNKS * WIDTH
FINE = 512  # symbols of 8 bits of the second signature
BLOCK = 512
_WORDS: dict[bytes, int] = kept({})
_POWERS = mix64(np.arange(1, WORDS + 2, dtype=np.uint64)) | np.uint64(1)
_TURNS = (mix64(np.arange(100, 100 + FINE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIPS = (mix64(np.arange(9000, 9000 + FINE, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _hashed(words: list[bytes]) -> np.ndarray:
    new = set(words).difference(_WORDS)
    if new:
        if len(_WORDS) > 300_000:
            _WORDS.clear()
            new = set(words)
        _WORDS.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def shingles(text: bytes, size: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the text's shingles, sorted; with fewer words than a shingle has, of the whole sequence as one."""
    h = np.concatenate([np.zeros(0, np.uint64), *map(_hashed, word_blocks(text))])
    if not len(h):
        return h
    n = len(h) - size + 1
    if n < 1:
        return mix64(np.array([(h * _POWERS[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    total = h[:n] * _POWERS[0]
    for k in range(1, size):
        total += h[k : k + n] * _POWERS[k]
    return np.unique(mix64(total))


def least(hashes: np.ndarray, symbols: int) -> np.ndarray:
    """MinHash values: for each symbol's permutation of 32-bit numbers the least image."""
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    out = np.full(symbols, np.uint32(2**32 - 1))
    for i in range(0, len(short), 8192):
        for k in range(0, symbols, 32):
            images = (short[None, i : i + 8192] ^ _FLIPS[k : k + 32, None]) * _TURNS[k : k + 32, None]
            np.minimum(out[k : k + 32], images.min(1), out=out[k : k + 32])
    return mix64(out.astype(np.uint64) + (np.arange(symbols, dtype=np.uint64) << np.uint64(32)))


def coarse(hashes: np.ndarray) -> bytes:
    return (least(hashes, SYMBOLS) >> np.uint64(48)).astype("<u2").tobytes()


def fine(hashes: np.ndarray) -> bytes:
    return (least(hashes, FINE) >> np.uint64(56)).astype(np.uint8).tobytes()


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """Rows of 16-bit symbols to their 32 keys: of each chunk, for each symbol that may be wrong, the three others."""
    s = signatures.astype(np.uint64)
    out = np.empty((len(s), SYMBOLS), np.uint64)
    for c in range(CHUNKS):
        for e in range(WIDTH):
            a, b, d = (s[:, c * WIDTH + k] for k in range(WIDTH) if k != e)
            out[:, c * WIDTH + e] = (np.uint64(c * WIDTH + e) << np.uint64(48)) | (a << np.uint64(32)) | (b << np.uint64(16)) | d
    return out


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key, by number, that two rows of symbols share; 255 if none. A pair is looked at in that bucket alone."""
    same = (a == b).reshape(len(a), CHUNKS, WIDTH)
    counts = same.sum(2)
    near = counts >= WIDTH - 1
    chunk = near.argmax(1)
    rows = np.arange(len(a))
    wrong = np.where(counts[rows, chunk] == WIDTH, 0, same[rows, chunk].argmin(1))
    return np.where(near.any(1), chunk * WIDTH + wrong, 255)


def least_agreement(similarity: float, symbols: int = FINE, deviations: float = 4.5) -> int:
    """Symbols that agree at least, but for a chance of a few in a million, when sets are as similar as that."""
    return int(np.floor(symbols * similarity - deviations * np.sqrt(symbols * similarity * (1 - similarity))))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only(_WORDS)
    for batch in slices(batches):
        n, digests, signatures = [], [], []
        for text in texts(batch):
            h = shingles(text)
            n.append(len(h))
            digests.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
            signatures.append(coarse(h) if len(h) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())], ["doc_id", "n", "digest", "signature"])


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1 << 20):
        keys = bucket_keys(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, SYMBOLS))
        ids, n = (np.repeat(batch.column(k).to_numpy(), SYMBOLS) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(ids), pa.array(n)], ["key", "id", "n"])


def _detailed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the classes' first documents: both signatures and the whole set."""
    only(_WORDS)
    for batch in slices(batches):
        rows = []
        for i, digest, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), texts(batch)):
            h = shingles(text)
            if len(h) and xxhash.xxh3_128_digest(h.tobytes()) == digest:
                rows.append((i, coarse(h) + fine(h), h.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["id", "sketch", "hashes"])


def _matrix(column) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _agreeing(at_least: int):
    def run(batches):
        for batch in slices(batches, 8 << 20):
            a, b = _matrix(batch.column(2))[:, 2 * SYMBOLS :], _matrix(batch.column(3))[:, 2 * SYMBOLS :]
            yield batch.select([0, 1]).filter(pa.array((a == b).sum(1) >= at_least))

    return run


def _confirmed(percent: int):
    def run(batches):
        for batch in slices(batches):
            linked = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                linked.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(linked, pa.bool_()))

    return run


def _within_blocks(percent: int, at_least: int):
    """Rows come sorted by bucket, block of members and block of probes. Pairs of a probe and a member of another component
    whose signatures are near enough; two probes meet where the one with the larger id is the member."""

    def solve(rows: pa.Table) -> pa.RecordBatch | None:
        ids, parts, n, member, probe, outside = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("id", "component", "n", "member", "probe", "outside"))
        key = rows.column("key")[0].as_py() >> 48
        sketch = _matrix(rows.column("sketch"))
        symbols, finer = np.ascontiguousarray(sketch[:, : 2 * SYMBOLS]).view("<u2"), sketch[:, 2 * SYMBOLS :]
        out = []
        for r in np.flatnonzero(probe).tolist():
            others = np.flatnonzero(member & (parts != parts[r]) & (~outside | (ids > ids[r])) & (100 * np.minimum(n, n[r]) >= percent * np.maximum(n, n[r])))
            if len(others):
                others = others[first_key(np.broadcast_to(symbols[r], (len(others), SYMBOLS)), symbols[others]) == key]
            if len(others):
                others = others[(finer[others] == finer[r]).sum(1) >= at_least]
                out.append(np.column_stack([np.minimum(ids[others], ids[r]), np.maximum(ids[others], ids[r])]))
        if not out:
            return None
        pairs = np.concatenate(out)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    def run(batches):
        held: pa.Table | None = None
        for batch in slices(batches, 4 << 20):
            new = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, new]) if held is not None else new
            marks = [held.column(c).to_numpy() for c in ("key", "block", "other")]
            cuts = np.flatnonzero(np.any([m[1:] != m[:-1] for m in marks], axis=0)) + 1
            at = 0
            for to in cuts.tolist():
                if (found := solve(held.slice(at, to - at))) is not None:
                    yield found
                at = to
            held = held.slice(at)
        if held is not None and held.num_rows and (found := solve(held)) is not None:
            yield found

    return run


def _joined(pairs: DataFrame, details: DataFrame, column: str) -> DataFrame:
    """Pairs with that column of both ends. A hot end is a skewed equi-join, which adaptive execution splits."""
    a = details.select(F.col("id").alias("a"), F.col(column).alias("of_a"))
    b = details.select(F.col("id").alias("b"), F.col(column).alias("of_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "of_a", "of_b")


def link_documents(docs: DataFrame, percent: int = 75, most_sent: int = 1_000_000) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs`` (columns read: doc_id, text).

    A document's set are its distinct shingles of five words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased; with fewer words,
    the sequence; two documents are linked if 100 * intersection >= percent * union. ``component_id`` is the smallest
    doc_id reachable. Null and empty texts have no shingles and no links. Rows that share a doc_id are one node: links
    of any of them count for all. A null doc_id has no links and a null component. An empty table gives an empty one.

    Documents with equal sets are one class, whose first document stands for it. 32 MinHash symbols of 16 bits are cut
    into 8 chunks of 4; by the pigeonhole principle two signatures with at most 15 different symbols agree in all but
    one symbol of some chunk, so with one error allowed in a chunk (four keys for each) every such pair shares a key.
    At a similarity of 0.75 a pair shares none with a chance of 0.00002.

    In each bucket the first document is compared with each other one; links are confirmed on the whole sets and give
    components. In a bucket that still holds several components, the members outside its largest one are probes. All
    members and the probes are cut into blocks, and each block of probes meets each block of members, each pair in the first bucket it
    shares, and a finer signature leaves out those far below the threshold before the sets are compared. Pairs within a
    component are never listed, and the rows dealt follow the pairs across components. ``most_sent`` bounds the ids sent
    to the executors to pick the documents whose sets are needed; beyond it that is a shuffled join. Sides of joins that
    may be skewed are written first, so that adaptive execution can split a hot key.
    """
    spark = docs.sparkSession
    ship(spark)
    base = scratch(spark, "near")
    at_least = least_agreement(percent / 100)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(f"{base}/{name}")
        return spark.read.parquet(f"{base}/{name}")

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = stored(source.mapInArrow(_sketched, "doc_id long, n long, digest binary, signature binary"), "sketches")
    classes = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("n").alias("n"), F.any_value("signature").alias("signature"))
    classes = stored(classes, "classes")
    keys = classes.select("id", "n", "signature").mapInArrow(_keyed, "key long, id long, n long")
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("id", "n")).alias("first")).where("size > 1"), "shared")
    members = stored(keys.join(shared, "key"), "members")
    pairs = members.where("id <> first.id AND 100 * least(n, first.n) >= %d * greatest(n, first.n)" % percent).select(F.col("first.id").alias("a"), F.col("id").alias("b")).distinct()
    wanted = members.select("id").distinct().join(classes.select("id", "digest"), "id")
    wanted = stored(wanted, "wanted")
    ids = wanted.select(F.col("id").alias("doc_id"), "digest")
    texts_wanted = source.join(F.broadcast(ids) if ids.count() <= most_sent else ids, "doc_id").select("doc_id", "text", "digest")
    repeated = sketches.where("digest IS NOT NULL").groupBy("doc_id", "digest").count().where("count > 1").limit(1).count()
    texts_wanted = texts_wanted.dropDuplicates(["doc_id", "text", "digest"]) if repeated else texts_wanted
    details = stored(texts_wanted.mapInArrow(_detailed, "id long, sketch binary, hashes binary"), "details")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        return stored(_joined(pairs, details, "hashes").mapInArrow(_confirmed(percent), "a long, b long"), name)

    near = stored(_joined(pairs, details, "sketch").mapInArrow(_agreeing(at_least), "a long, b long"), "near")
    links = confirmed(near, "links")
    parts = stored(components(links), "parts")
    several = members.where("size > 2").select("key", "id", "n", "size").join(parts, "id", "left").withColumn("component", F.coalesce("component", "id"))
    several = stored(several, "several")
    sizes = several.groupBy("key", "component").agg(F.count("*").alias("held"))
    largest = F.max(F.struct("held", "component"))
    open_keys = stored(sizes.groupBy("key").agg(largest.alias("largest"), F.sum("held").alias("all")).where("all > largest.held").select("key", F.col("largest.component").alias("largest"), (F.col("all") - F.col("largest.held")).alias("probes"), "all"), "open")
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    own = lambda n: F.pmod(F.xxhash64("id"), blocks(n)).cast("int")
    every = lambda n: F.sequence(F.lit(0), blocks(n) - 1)
    rows = several.join(open_keys, "key").withColumn("outside", F.col("component") != F.col("largest"))
    as_member = F.transform(every("probes"), lambda j: F.struct(own("all").alias("block"), j.alias("other")))
    as_probe = F.when(F.col("outside"), F.transform(every("all"), lambda i: F.struct(i.alias("block"), own("probes").alias("other")))).otherwise(F.array())
    rows = rows.withColumn("task", F.explode(F.array_distinct(F.concat(as_member, as_probe)))).withColumn("member", F.col("task.block") == own("all")).withColumn("probe", F.col("outside") & (F.col("task.other") == own("probes")))
    rows = rows.select("key", "task.block", "task.other", "id", "component", "n", "member", "probe", "outside").join(details.select("id", "sketch"), "id")
    across = rows.repartition("key", "block", "other").sortWithinPartitions("key", "block", "other").mapInArrow(_within_blocks(percent, at_least), "a long, b long")
    more = confirmed(stored(across.distinct(), "across"), "more")
    placed = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").join(classes.select("digest", "id"), "digest").select("doc_id", "id")
    several_texts = placed.groupBy("doc_id").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("doc_id")
    bridges = placed.join(several_texts, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))
    whole = components(links.unionByName(more).unionByName(bridges))
    named = classes.select("digest", "id").join(whole, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    out = sketches.where("digest IS NOT NULL AND doc_id IS NOT NULL").join(named, "digest").select("doc_id", "n", "component_id")
    rest = sketches.where("digest IS NULL OR doc_id IS NULL").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
