import json
import random
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from quillmark.llm import packing, sstable, tokens
from quillmark.llm.common import scratch
from quillmark.llm.tokens import END_ID, WordEncoder, default_tokenizer
from tests.llm.helpers import corpus, frame

ODD = ["", " ", "a<|endoftext|>b c", "İstanbul café x́ y ́z", "don't we'll 'ss' it's,", "\x1c\x85q  w", "Σίσυφος, ΟΔΟΣ.", "a" * 500 + " b!!", "3.14, x2 ²½", "日本語 テキスト。"]


def encoded(text):
    library = encoded.__dict__.setdefault("library", WordEncoder(default_tokenizer()).library)
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, END_ID], "<u4")


def test_word_by_word_ids_are_the_librarys():
    for most in (600_000, 3):
        encoder = WordEncoder(default_tokenizer(), most=most)
        for _ in range(2):
            assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode([t.encode() for t in ODD], np.array([END_ID], "<u4").tobytes())] == [encoded(t).tolist() for t in ODD]


PARTS = ["the", "The", "ÉTÉ", "ß", "ÿ", "×", "µ", "İ", "H\u0331", "\u0301", "'", "'LL", "<", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", ",", "!!", "%%", "_", "42", "½", " ", "\n", "\x1c", "\0", "\x85", "\xa0", "日", "Σ", "😀"]


def random_texts(seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 2, 5, 20, 60]))) for _ in range(400)]


def same_ids(encoder, texts):
    wanted = [np.array([*encoder.library.encode(t, add_special_tokens=False).ids, END_ID], "<u4").tobytes() for t in texts]
    return encoder.encode([t.encode() for t in texts], np.array([END_ID], "<u4").tobytes()) == wanted


@pytest.mark.parametrize("stretch", [16, 4 << 20])
def test_ids_of_random_pieces_are_the_librarys(monkeypatch, stretch):
    monkeypatch.setattr(tokens, "STRETCH", stretch, raising=False)
    assert same_ids(WordEncoder(default_tokenizer(), most=20), random_texts(stretch))


def test_ids_of_a_tokenizer_that_keeps_case_are_the_librarys(tmp_path):
    made = json.load(open(default_tokenizer(), encoding="utf-8"))
    made["normalizer"]["normalizers"] = [x for x in made["normalizer"]["normalizers"] if x["type"] != "Lowercase"]
    path = tmp_path / "cased.json"
    path.write_text(json.dumps(made), encoding="utf-8")
    assert same_ids(WordEncoder(str(path)), random_texts(1))


def test_a_word_that_comes_back_is_encoded_once_in_any_form(monkeypatch):
    encoder, learned = WordEncoder(default_tokenizer(), most=40), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    for k in range(20):
        fresh = [f"{chr(97 + k)}x{chr(97 + i)}q" for i in range(10)]
        assert same_ids(encoder, ["the The, THE. the!! " + " ".join(fresh)])
    assert [x for x in learned if x.lower().startswith(b"the")] == [b"the"]


def test_shards_round_trip_in_order(spark):
    rows = corpus() + corpus()[20:23]
    uri = scratch(spark, "shards")
    made = sstable.write_shards(frame(spark, rows), uri, shard_bytes=20_000)
    found = sstable.read_shards(spark, uri, made).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in found] == [r[0] for r in order]
    start, wanted = 0, {}
    for r in order:
        wanted.setdefault(r[0], []).append(encoded(r[1]).tobytes())
    for r in found:
        assert r.start == start and len(r.ids) == 4 * r.n_tokens and bytes(r.ids) in wanted[r.doc_id]
        start += r.n_tokens
    some = [r[0] for r in rows[18:24]] + [10**9]
    got = sstable.lookup(spark, uri, made, some).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((i is None, i or 0, x) for i in some for x in wanted.get(i, []))


def test_empty_tables(spark):
    uri = scratch(spark, "shards")
    made = sstable.write_shards(frame(spark, []), uri)
    assert made == [] and sstable.read_shards(spark, uri, made).collect() == []
    assert packing.pack(frame(spark, [])).collect() == []


def checked(pieces, rows, size, crc=False):
    ids = {}
    for i, t, *_ in rows:
        ids.setdefault(i, []).append(encoded(t))
    total = 0
    for r in pieces:
        own = [x for x in ids[r.doc_id] if len(x) == r.doc_tokens]
        raw = [x[r.start : r.start + r.length].tobytes() for x in own]
        assert (bytes(r.ids) in [zlib.crc32(x).to_bytes(4, "big") for x in raw]) if crc else bytes(r.ids) in raw
        total += r.length
    assert total == sum(len(x) for xs in ids.values() for x in xs)
    windows = {}
    for r in pieces:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return [sum(n for _, n in w) for w in windows.values()]


def test_packing_keeps_every_id_and_pads_nothing(spark):
    rows = corpus() + corpus()[20:23]
    for crc in (False, True):
        pieces = packing.pack(frame(spark, rows), size=256, space=3, fan_in=2, keep_ids=not crc).collect()
        sizes = checked(pieces, rows, 256, crc)
        assert all(n & (n - 1) == 0 for n in sizes)


def test_packing_encodes_a_word_that_comes_back_once(monkeypatch):
    encoder, learned = WordEncoder(default_tokenizer(), most=40), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda pieces: learned.extend(pieces) or learn(pieces))
    monkeypatch.setattr(packing, "encoder", lambda path: encoder)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rows = [(k, "the The, THE. " + " ".join(f"{chr(97 + k)}x{chr(97 + i)}q" for i in range(10))) for k in range(20)]
    batches = [pa.RecordBatch.from_pylist([{"doc_id": k, "text": t}]) for k, t in rows]
    windows = [w for b in packing._first(iter(batches), "", 64, 4, True, True) for w in b.to_pylist()]
    assert [x for x in learned if x.lower().startswith(b"the")] == [b"the"]
    found = {}
    for p in sorted((p for w in windows for p in w["pieces"]), key=lambda p: (p["doc_id"], p["start"])):
        found[p["doc_id"]] = found.get(p["doc_id"], b"") + p["ids"]
    assert found == {k: encoded(t).tobytes() for k, t in rows}


def placed(spark, rows, partitions):
    """Documents of so many ids in these partitions: rows of (partition, ids)."""
    texts = [(k, p, "a " * (n - 1)) for k, (p, n) in enumerate(rows)]
    frames = [spark.createDataFrame([(k, t) for k, q, t in texts if q == p], "doc_id long, text string").coalesce(1) for p in range(partitions)]
    docs = frames[0]
    for f in frames[1:]:
        docs = docs.union(f)
    return docs, [(k, t) for k, _, t in texts]


def test_packing_loses_no_window_where_later_partitions_close_exactly(spark):
    docs, rows = placed(spark, [(0, 3), (1, 3), (2, 8), (3, 8)], 4)
    sizes = checked(packing.pack(docs, size=8, fan_in=2).collect(), rows, 8)
    assert sorted(sizes) == [2, 4, 8, 8]


@pytest.mark.parametrize("seed", range(4))
def test_packing_random_partitions(spark, seed):
    rng = random.Random(seed)
    partitions, size = rng.choice([1, 3, 5, 7]), rng.choice([4, 8, 16])
    docs, rows = placed(spark, [(rng.randrange(partitions), rng.choice([1, size // 2, size, rng.randint(1, 3 * size)])) for _ in range(rng.randint(1, 30))], partitions)
    sizes = checked(packing.pack(docs, size=size, space=rng.randint(1, 3), fan_in=rng.randint(2, 4)).collect(), rows, size)
    assert all(n & (n - 1) == 0 for n in sizes)


def test_packing_whole_documents_when_asked(spark):
    rows = corpus()
    pieces = packing.pack(frame(spark, rows), size=4096, cut=False).collect()
    checked(pieces, rows, 4096)
    assert all(r.length == r.doc_tokens for r in pieces if r.doc_tokens < 4096)
