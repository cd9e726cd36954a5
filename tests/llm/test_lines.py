import re

import numpy as np
import pytest

from quillmark.llm.lines import drop_shared_lines
from quillmark.llm.perfect_hash import LineIndex, PerfectHash
from tests.llm.helpers import corpus, frame

NO_ID = -(2**63)


def key(line):
    low = re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line)
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in low)


def brute(rows, least=5):
    held = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(NO_ID if i is None else i)
    last = {k: max(v) for k, v in held.items() if len(v) >= least}
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == (NO_ID if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bound", [64 << 20, 0])
def test_both_ways_equal_brute_force(spark, bound):
    rows = corpus() + corpus()[:6]
    out = drop_shared_lines(frame(spark, rows), broadcast_bytes=bound)
    assert out.columns[:3] == ["doc_id", "text", "lang"]
    found = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect()), key=repr)
    assert found == brute(rows)
    assert any(x[3] for x in found)


def test_empty_table(spark):
    assert drop_shared_lines(frame(spark, [])).collect() == []


def test_perfect_hash_is_minimal_and_index_knows_its_own():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    places = PerfectHash.build(keys).places(keys)
    assert sorted(places.tolist()) == list(range(5000))
    digests = np.column_stack([keys, keys[::-1]])
    index = LineIndex.loads(LineIndex.build(digests, np.arange(5000) + 1, np.arange(5000)).dumps())
    n, last = index.find(digests)
    assert (n == np.arange(5000) + 1).all() and (last == np.arange(5000)).all()
    assert index.find(digests[:, ::-1] + np.uint64(1))[0].sum() == 0
    none = LineIndex.loads(LineIndex.build(digests[:0], np.zeros(0), np.zeros(0, np.int64)).dumps())
    assert none.find(digests)[0].sum() == 0
