import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm.embedding_dedup import link_vectors
from quillmark.llm.topk import top_k
from tests.llm.test_near import reach

SCHEMA = "vec_id long, embedding array<float>, label int, score double"


def table(seed=0, n=260, wide=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, wide)).astype(np.float32)
    for i in range(0, n, 4):
        x[i] = x[i // 8] + rng.normal(scale=0.03, size=wide)
    x[100:130] = x[5]
    rows = [(i, [float(v) for v in x[i]], int(i % 3) if i % 17 else None, 0.0) for i in range(n)]
    rows += [(900, None, 1, 0.0), (901, [0.0] * wide, 1, 0.0), (902, [float("nan")] * wide, 1, 0.0), (903, [None] + [1.0] * (wide - 1), 1, 0.0), (904, [float("inf")] * wide, 1, 0.0), (None, [1.0] * wide, 1, 0.0)]
    return rows


def usable(v):
    return v is not None and all(c is not None and np.isfinite(c) for c in v)


def test_top_k_is_exact(spark):
    rows = table() + table()[:3]
    out = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 10 == 0, k=5, pivots=6, query_block=7, data_block=50)
    found = {}
    for r in out.collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    good = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v, *_ in rows if i is not None and usable(v)}
    for q in good:
        if q % 10 == 0:
            best = sorted(((-int(good[q] @ x), i) for i, x in good.items() if i != q))[:5]
            assert [found[q][k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert set(found) == {q for q in good if q % 10 == 0}


def test_top_k_of_a_zero_vector(spark):
    rows = [r for r in table() if r[0] != 0]
    out = top_k(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") == 901).collect()
    assert sorted((r["rank"], r.query_id, r.vec_id, r.score) for r in out) == [(k, 901, k, 0) for k in range(1, 11)]


def test_top_k_of_few_rows_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0), (1, [0.5, 0.0], 1, 0.0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1)]
    assert top_k(few.where("false"), F.lit(True)).collect() == []
    mixed = spark.createDataFrame([(0, [1.0, 0.0], 1, 0.0), (1, [0.5, 0.0], 1, 0.0), (2, [1.0], 1, 0.0), (3, [], 1, 0.0)], SCHEMA)
    assert [(r.query_id, r["rank"], r.vec_id) for r in top_k(mixed, F.lit(True)).orderBy("query_id").collect()] == [(0, 1, 1), (1, 1, 0)]
    tied = spark.createDataFrame([(i, [1.0, 2.0], 1, 0.0) for i in range(30)] * 3, SCHEMA)
    assert sorted((r["rank"], r.vec_id) for r in top_k(tied, F.col("vec_id") == 4, data_block=7).collect()) == [(k + 1, k + (k >= 4)) for k in range(10)]


def test_links_are_exact(spark):
    rows = table(2)
    out = link_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3), cell_rows=20, block_rows=16).collect()
    assert len(out) == len(rows)
    good = [(i, np.array(v, np.float64), lab) for i, v, lab, _ in rows if i is not None and lab is not None and usable(v) and any(v)]
    links = [(a, b) for a, x, p in good for b, y, q in good if a != b and p == q and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= 0.98]
    roots = reach({r[0] for r in rows if r[0] is not None}, links)
    counts = {}
    for a, _ in links:
        counts[a] = counts.get(a, 0) + 1
    for r in out:
        assert (r.n_links, r.component_id) == (counts.get(r.vec_id, 0), roots.get(r.vec_id))
        assert r.kept == (r.vec_id == r.component_id)
    assert len(links) > 100


def test_links_of_repeated_ids_and_other_widths(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1, 0.0), (1, [0.0, 1.0, 0.0], 1, 0.0), (2, [1.0, 0.01, 0.0], 1, 0.0), (3, [0.0, 1.0, 0.01], 1, 0.0), (4, [0.0, 1.0, 0.0], 1, 0.0), (5, [0.0, 1.0, 0.0], 2, 0.0)]
    rows += [(6, [1.0, 0.0], 1, 0.0), (7, [], 1, 0.0), (8, [1.0, 0.0], 1, 0.0)]
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(spark.createDataFrame(rows, SCHEMA)).collect())
    assert out == [(1, 1, 1, True), (1, 2, 1, True), (2, 1, 1, False), (3, 2, 1, False), (4, 2, 1, False), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True)]


@pytest.mark.parametrize("kind", ["double", "int", "long"])
def test_other_kinds_of_numbers(spark, kind):
    rows = [(i, [float(int(50 * c)) for c in v], label, 0.0) for i, v, label, _ in table(3, 120) if i is not None and usable(v)]
    typed = spark.createDataFrame(rows, SCHEMA).withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))
    plain = spark.createDataFrame(rows, SCHEMA)
    for run in (link_vectors, lambda t: top_k(t, F.col("vec_id") % 20 == 0)):
        assert sorted(map(tuple, run(typed).collect())) == sorted(map(tuple, run(plain).collect()))


def test_links_of_no_rows(spark):
    assert link_vectors(spark.createDataFrame([], SCHEMA)).collect() == []
