import random

import numpy as np

from quillmark.llm import near_dedup
from quillmark.llm.common import components
from tests.llm.helpers import corpus, frame, sentence


def sets(rows):
    out = {}
    for i, t, *_ in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()
        out.setdefault(i, []).append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    return out


def reach(nodes, links):
    root = {x: x for x in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def brute(rows):
    s = {i: v for i, v in sets(rows).items() if i is not None}
    links = [(a, b) for a in s for b in s if a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in s[a] for y in s[b])]
    return reach(s, links)


def variants(seed, n=40, words=60):
    rng = random.Random(seed)
    base = sentence(rng, words).split()
    rows = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(words)] = f"edit{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(w), None, None, 0, 0.0, None, 0))
    return rows


def test_components_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rows = corpus() + corpus()[5:9] + variants(1) + variants(2)
    out = near_dedup.link_documents(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    wanted, sizes = brute(rows), sets(rows)
    for r in out:
        assert r.component_id == wanted.get(r.doc_id)
        assert r.n_shingles in [len(x) for x in sizes[r.doc_id]]
        assert r.kept == (r.doc_id == r.component_id)


def test_one_large_component_and_others_in_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    rng = random.Random(11)
    base = sentence(rng, 80).split()
    rows = []
    for k in range(60):  # most edit the middle; some share only the first half or so
        w = list(base)
        w[40] = f"edit{k}"
        if k % 7 == 0:
            w[44 + k % 3 * 5 :] = [f"own{k // 21}x{i}" for i in range(36 - k % 3 * 5)]
        rows.append((500 - k, " ".join(w), None, None, 0, 0.0, None, 0))
    out = near_dedup.link_documents(frame(spark, rows * 2)).collect()
    wanted = brute(rows)
    assert len(out) == 120 and len(set(wanted.values())) > 2
    assert all(r.component_id == wanted[r.doc_id] for r in out)


def test_recall_just_over_the_threshold():
    """Planted pairs of similarity 0.75 to 0.80: nearly all share a key, and none falls to the finer signature."""
    rng, missed, lost, n = np.random.default_rng(3), 0, 0, 3000
    for k in range(n):
        size = int(rng.integers(40, 400))
        both = int(np.ceil(rng.uniform(0.75, 0.80) * size))
        h = near_dedup.mix64(rng.integers(0, 2**63, size).astype(np.uint64))
        alone = int(rng.integers(0, size - both + 1))
        a, b = np.sort(h[: both + alone]), np.sort(np.concatenate([h[:both], h[both + alone :]]))
        assert len(np.intersect1d(a, b)) >= 0.75 * size
        x, y = (np.frombuffer(near_dedup.coarse(v), "<u2")[None] for v in (a, b))
        missed += not (near_dedup.bucket_keys(x) == near_dedup.bucket_keys(y)).any()
        if k % 10 == 0:
            p, q = (np.frombuffer(near_dedup.fine(v), np.uint8) for v in (a, b))
            lost += (p == q).sum() < near_dedup.least_agreement(0.75)
    assert missed <= 1 and lost == 0


def test_shuffled_way_and_empty_table(spark):
    rows = variants(4, 12)
    out = near_dedup.link_documents(frame(spark, rows), most_sent=0).collect()
    assert {r.doc_id: r.component_id for r in out} == brute(rows)
    assert near_dedup.link_documents(frame(spark, [])).collect() == []


def test_every_pair_within_fifteen_errors_shares_a_key():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 2**16, (300, 32)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(32, 15, replace=False)] ^= 1
    shared = (near_dedup.bucket_keys(a) == near_dedup.bucket_keys(b))
    assert shared.any(1).all()
    assert (near_dedup.first_key(a, b) == shared.argmax(1)).all()


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, k) for k in range(101, 140)] + [(200, 200), (139, 300), (300, 299)]
    found = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {k: v for k, v in reach({x for p in links for x in p}, links).items() if k != 200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
