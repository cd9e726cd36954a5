import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import mixing, ppm, quality, toxicity
from quillmark.llm.common import crc32_of_id
from tests.llm.helpers import corpus, frame, sentence

LABELS = "doc_id long, quality int, toxic int"


def brute_segments(scores):
    """All maximal scoring segments by their definition: the best segment, then those left and right of it."""

    def best(lo, hi):
        found, at = 0.0, None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > found + 1e-12:
                    found, at = total, (i, j + 1)
        return [] if at is None else [*best(lo, at[0]), (*at, found), *best(at[1], hi)]

    return best(0, len(scores))


def test_segments_are_all_maximal_ones():
    rng = np.random.default_rng(0)
    for n in (0, 1, 5, 30):
        for _ in range(40):
            scores = np.round(rng.normal(-0.2, 1, n), 3)
            found = [(a, b, round(s, 6)) for a, b, s in toxicity.segments(scores)]
            assert found == [(a, b, round(s, 6)) for a, b, s in brute_segments(scores)]


def toxic_corpus(n=900):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(n):
        words = sentence(rng, rng.randint(20, 120)).split()
        toxic = i % 6 == 0
        for _ in range(4 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilestone", "vilesand", "grumble"]))
        good = i % 5 != 1
        if not good:
            words = [f"{w.upper()}!!" for w in words] if i % 2 else [w for w in words for _ in range(5)]
        docs.append((i, " ".join(words), None, None, 0, 0.0, None, 0))
        if i % 7:
            labels.append((i, int(good), int(toxic)))
    return docs, labels


def test_toxicity_learns_words_and_stems(spark):
    docs, labels = toxic_corpus()
    model = toxicity.train(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    rows = [*docs, (5000, "kara vilesky kase mira kara", None, None, 0, 0.0, None, 0), (5001, None, None, None, 0, 0.0, None, 0), (5002, "", None, None, 0, 0.0, None, 0)]
    out = {r.doc_id: r for r in toxicity.score(frame(spark, rows), model).collect()}
    held = [i for i, *_ in docs if crc32_of_id(i) % 4 == 2]
    assert np.mean([(out[i].score >= 0.3) == (i % 6 == 0) for i in held]) > 0.97
    assert out[5000].score >= 0.3 and [(p.first, p.end) for p in out[5000].passages] == [(1, 2)]  # an unseen word of a learned stem
    assert out[5001].score < 0.3 and out[5001].passages == [] and out[5002].score == out[5001].score


def test_quality_ranks_and_cuts(spark):
    docs, labels = toxic_corpus()
    model = quality.train(frame(spark, docs), spark.createDataFrame(labels, LABELS))
    out = {r.doc_id: r.score for r in quality.score(frame(spark, docs), model).collect()}
    held = [i for i, *_ in docs if crc32_of_id(i) % 4 == 2]
    assert np.mean([(out[i] >= 0.7) == (i % 5 != 1) for i in held]) > 0.97
    kept = quality.keep_good(frame(spark, docs), model)
    assert kept.columns == frame(spark, docs).columns and kept.count() == sum(s >= 0.7 for s in out.values())


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 0, 1), (2, 0, 1)]])
def test_scores_without_labels_of_both_kinds(spark, labels):
    docs, table = frame(spark), spark.createDataFrame(labels, LABELS)
    for scored in (toxicity.score(docs, toxicity.train(docs, table)), quality.score(docs, quality.train(docs, table))):
        rows = scored.collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    nothing = frame(spark, [])
    assert toxicity.score(nothing, toxicity.train(nothing, table)).collect() == [] and quality.score(nothing, quality.train(nothing, table)).collect() == []


def lowered(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode().split()


class PlainPpm:
    """Prediction by partial matching with dictionaries and one symbol at a time: symbols of longer contexts are excluded by
    name, a symbol that came c of n times has (c - 1/2) / n, and each kind of symbol gives half a count to the escape."""

    def __init__(self, texts, order):
        self.order, self.after = order, {}
        for t in texts:
            form = b"\n" * order + b" ".join(lowered(t)) + b"\n"
            for i in range(order, len(form)):
                for j in range(order + 1):
                    self.after.setdefault(form[i - j : i], Counter())[form[i]] += 1

    def chance(self, before, symbol):
        out, excluded = 1.0, set()
        for j in range(self.order, -1, -1):
            came = self.after.get(before[len(before) - j :])
            if came is None:
                continue
            open_ = {s: c for s, c in came.items() if s not in excluded}
            total = sum(open_.values())
            if symbol in open_:
                return out * (open_[symbol] - 0.5) / total
            if total:
                out *= 0.5 * len(open_) / total
            excluded |= set(came)
        return out / max(1, 256 - len(self.after.get(b"", ())))

    def score(self, text):
        form = b"\n" * self.order + b" ".join(lowered(text)) + b"\n"
        return sum(math.log10(self.chance(form[i - self.order : i], form[i])) for i in range(self.order, len(form)))


def test_plain_chances_sum_to_one():
    model = PlainPpm([t for _, t, *_ in corpus()[:12]], 3)
    for before in (b"\n\n\n", b"kar", b"ra ", b"zzz", b"zka"):
        assert sum(model.chance(before, s) for s in range(256)) == pytest.approx(1)


def test_grams_are_counted_whatever_the_stretches_and_slots():
    texts = [t or "" for _, t, *_ in corpus()]
    plain = Counter()
    for t in texts:
        form = b"\n" * 3 + b" ".join(lowered(t)) + b"\n"
        plain.update(int.from_bytes(form[i - 3 : i + 1], "big") for i in range(3, len(form)))
    for limit, slots, most in ((1 << 20, 1 << 10, 200), (7, 1 << 4, 50), (100, 1 << 16, 10**6)):
        counter, left = ppm.GramCounter(slots, most), []
        for t in texts:
            parts = [p for _, complete in ppm.stretches(t.encode(), 3, limit) for p in complete]
            left.append(counter.add(ppm.grams(parts, 3)[0]))
        left = [x for x in left if x is not None] + [counter.rest()]
        keys, counts = ppm.summed(np.concatenate([x[0] for x in left]), np.concatenate([x[1] for x in left]))
        assert dict(zip(keys.tolist(), counts.tolist())) == plain


@pytest.mark.parametrize("head", [200_000, 5])
def test_baseline_equals_brute_force(spark, head):
    rows = corpus() + corpus()[:4]
    docs = frame(spark, rows).withColumn("held", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))
    out = ppm.score(docs, ~F.col("held"), head_words=head).collect()
    train = Counter()
    for i, t, *_ in rows:
        if i is None or i % 4:
            train.update([*lowered(t), b"\n"])
    total, kinds = sum(train.values()), len(train)
    wanted = {}
    for i, t, *_ in rows:
        w = [*lowered(t), b"\n"]
        base = sum(math.log10((train[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w)
        wanted[i] = (len(w), sum(x in train for x in w), round(base, 6))
    assert len(out) == len(rows)
    for r in out:
        assert (r.n_tokens, r.n_known, round(r.base_score, 6)) == wanted[r.doc_id] and r.train_tokens == total and r.score < 0


@pytest.mark.parametrize("most", [10**9, 300, 20])
def test_ppm_scores_by_every_counted_pair_however_few_are_sent(spark, most):
    rows = [*corpus(), (4 * 10**6, "zzz qqq karana \u00e9\u00e8 kara", "en", "src0", 0, 1.0, False, -1), (8 * 10**6, "qqz " * 5000, "en", "src0", 0, 1.0, False, -1)]
    docs = frame(spark, rows).withColumn("held", F.coalesce(F.col("doc_id") % 4 == 0, F.lit(False)))
    model = PlainPpm([t for i, t, *_ in rows if i is None or i % 4], 5)
    out = ppm.score(docs, ~F.col("held"), head_grams=most).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.score == pytest.approx(model.score(next(t for i, t, *_ in rows if i == r.doc_id)), rel=1e-9)


def test_ppm_reads_a_long_text_in_stretches(spark):
    """30 MB in one text: the workers' peak stays far under the arrays that the whole text would take."""
    import tracemalloc

    text = ("kara lose mitina nupo " * 40 + "\n") * (30_000_000 // 881)
    tracemalloc.start()
    n = sum(len(w) for w, _ in ppm.stretches(text.encode(), 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == len(text.split()) + 1 and peak < 80 << 20
    docs = spark.createDataFrame([(1, text), (2, "kara lose"), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in ppm.score(docs).collect()}
    assert out[1].n_tokens == n == out[1].n_known and out[1].train_tokens == n + 4
    assert out[3].n_tokens == 1 and all(r.score < 0 for r in out.values())


def test_ppm_without_rows_or_training(spark):
    assert ppm.score(frame(spark, [])).collect() == []
    out = ppm.score(frame(spark), F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in out)


def test_rake_meets_margins_and_supply():
    rng = np.random.default_rng(4)
    supply = rng.integers(50, 500, 24).astype(float)
    places = [np.repeat(np.arange(4), 6), np.tile(np.repeat(np.arange(3), 2), 4), np.tile(np.arange(2), 12)]
    targets = [np.array([0.3, 0.3, 0.2, 0.2]), np.array([0.3, 0.3, 0.4]), np.array([0.5, 0.5])]
    w = mixing.rake(supply, places, targets, 0.4 * supply.sum())
    assert (w <= supply + 1e-9).all() and (w >= 0).all()
    for at, share in zip(places, targets):
        assert np.bincount(at, w) / w.sum() == pytest.approx(share, abs=1e-3)


@pytest.mark.parametrize("hot", [0, 5])
def test_rake_lets_every_cell_be_drawn_where_one_source_has_a_third(hot):
    sources, langs, topics = 20, 4, 8
    rng = np.random.default_rng(7)
    supply = np.einsum("i,j,k->ijk", np.ones(sources), [0.61, 0.15, 0.15, 0.09], [0.35, 0.35, 0.05, 0.05, 0.05, 0.05, 0.05, 0.05]) * rng.uniform(0.8, 1.2, (sources, langs, topics)) * 1e5
    supply[hot] *= 10
    places = [x.ravel() for x in np.indices(supply.shape)]
    supply = supply.ravel()
    assert 0.3 < supply[places[0] == hot].sum() / supply.sum() < 0.4
    targets = [np.bincount(at, supply) ** p for at, p in zip(places, (0.5, 0.7, 0.0))]
    w = mixing.rake(supply, places, [t / t.sum() for t in targets], 0.7 * supply.sum())
    assert (w <= supply + 1e-9).all() and (w / supply).min() > 0.02


def test_mixing_tempers_each_of_many_sources_by_itself(spark):
    rows = [(i, "kara " * (100 + i % 37 * 9), "en", f"src{i}", 0, 1.0, False, -1) for i in range(400)]
    out = mixing.mix(mixing.measured(frame(spark, rows)), [mixing.Margin("source", power=0.5)], 0.4).collect()
    assert {r.source: r.n_tokens for r in out} == {f"src{i}": 100 + i % 37 * 9 for i in range(400)}
    roots = sum(r.n_tokens**0.5 for r in out)
    for r in out:
        assert r.probability * r.n_tokens == pytest.approx(0.4 * sum(x.n_tokens for x in out) * r.n_tokens**0.5 / roots, rel=1e-6)


def plain_rake(cells, margins, budget):
    """The rule of raking over dictionaries, a cell at a time: margins[m](cell) names the cell's category, targets[m] its share."""
    total, even = sum(cells.values()), budget / sum(cells.values())
    weight, least, aims = {c: n * even for c, n in cells.items()}, {c: n * even * mixing.LEAST for c, n in cells.items()}, []
    for name, shares in margins:
        supply = Counter()
        for c, n in cells.items():
            supply[name(c)] += n
        aim = {k: shares[k] * budget for k in supply}
        for _ in aim:
            full = {k for k in aim if aim[k] >= supply[k]}
            aim = {k: supply[k] if k in full else v for k, v in aim.items()}
            room, missing = sum(v for k, v in aim.items() if k not in full), budget - sum(aim.values())
            if missing <= 1e-12 * budget or not room:
                break
            aim = {k: v if k in full else v * (1 + missing / room) for k, v in aim.items()}
        aim = {k: min(v, supply[k]) for k, v in aim.items()}
        aims.append(aim)
        least = {c: v * min(1, aim[name(c)] / (supply[name(c)] * even)) for c, v in least.items()}
    for _ in range(500):
        for (name, _), aim in zip(margins, aims):
            have, free = Counter(), Counter()
            for c, w in weight.items():
                have[name(c)] += w
                free[name(c)] += w if w < cells[c] else 0
            for c, w in weight.items():
                k = name(c)
                if w < cells[c]:
                    w *= max(aim[k] - (have[k] - free[k]), 0) / free[k]
                elif have[k] > aim[k]:
                    w *= aim[k] / have[k]
                weight[c] = min(max(w, least[c]), cells[c])
    return {c: w / cells[c] for c, w in weight.items()}


def test_mixing_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, "kara " * rng.randint(1, 60), rng.choice(["en", "en", "de", None]), rng.choice(["a", "a", "a", "b", "c"]), 0, 1.0, False, -1) for i in range(300)]
    cells = Counter()
    for _, t, lang, source, *_ in rows:
        cells[source, lang or mixing.NONE] += len(t.split())
    shares = []
    for at, power in ((0, 0.5), (1, 0.0)):
        raised = Counter()
        for c, n in cells.items():
            raised[c[at]] += n
        raised = {k: v**power for k, v in raised.items()}
        shares.append({k: v / sum(raised.values()) for k, v in raised.items()})
    wanted = plain_rake(dict(cells), [(lambda c: c[0], shares[0]), (lambda c: c[1], shares[1])], 0.6 * sum(cells.values()))
    out = mixing.mix(mixing.measured(frame(spark, rows)), [mixing.Margin("source", power=0.5), mixing.Margin("lang", power=0.0)], 0.6)
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(29), "doc_id", F.xxhash64("text")), 11) / 2.0**53
    rows = out.withColumn("drawn", drawn).collect()
    for r in rows:
        assert r.probability == pytest.approx(wanted[r.source, r.lang or mixing.NONE], abs=1e-6)
        assert r.kept == (r.drawn < r.probability)
    assert sum(r.n_tokens for r in rows if r.kept) / sum(r.n_tokens for r in rows) == pytest.approx(0.6, abs=0.08)


def test_topics_are_clusters_of_vocabulary(spark):
    rng = random.Random(6)
    vocabularies = [[f"{stem}{k:03d}" for k in range(60)] for stem in ("garden", "engine", "violin", "harbor")]
    rows = [(i, " ".join(rng.choice(vocabularies[i % 4]) for _ in range(rng.randint(30, 80))), None, None, 0, 0.0, None, 0) for i in range(200)]
    rows += [(1000, None, None, None, 0, 0.0, None, 0), (1001, "a b c", None, None, 0, 0.0, None, 0)]
    found = [{r.doc_id: r.topic for r in mixing.measured(frame(spark, rows).repartition(n), topics=4).collect()} for n in (1, 5)]
    assert found[0] == found[1] and found[0][1000] == found[0][1001] == "topic0"
    groups = [{found[0][i] for i in range(k, 200, 4)} for k in range(4)]
    assert all(len(g) == 1 for g in groups) and len(set.union(*groups)) == 4
    own = mixing.measured(frame(spark, rows).withColumn("topic", F.when(F.col("doc_id") % 2 == 0, "news")))
    assert {(r.doc_id % 2, r.topic) for r in own.collect()} == {(0, "news"), (1, None)}


def test_mixing_keeps_every_row_and_draws_alike(spark):
    rows = corpus() * 2
    sized = mixing.measured(frame(spark, rows))
    assert {r.doc_id: r.n_tokens for r in sized.collect() if r.doc_id is not None} == {i: len((t or "").encode().split()) for i, t, *_ in rows if i is not None}
    margins = [mixing.Margin("source", {"src0": 0.5, "src1": 0.3, mixing.OTHER: 0.2}), mixing.Margin("lang", power=0.5)]
    out = mixing.mix(sized, margins, 0.5).collect()
    assert len(out) == len(rows) and all(0 <= r.probability <= 1 for r in out)
    drawn = {}
    for r in out:
        assert drawn.setdefault((r.doc_id, r.text), r.kept) == r.kept
    table = {}
    for r in out:
        table[r.source] = table.get(r.source, 0) + r.n_tokens * r.probability
    assert table["src0"] / sum(table.values()) <= 0.5 + 1e-6
    assert mixing.mix(mixing.measured(frame(spark, [])), margins, 0.5).collect() == []


def test_ranking_weights_and_cut_by_brute_force():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.7).astype(int)
    x = rng.normal(size=(400, len(quality.FEATURES))) + y[:, None] * np.linspace(0, 1, len(quality.FEATURES))
    model = quality.fit(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -6, 6)
    z = np.concatenate([z, z**2], 1)
    better, worse = quality.preference_pairs(y, 20)
    assert (y[better] == 1).all() and (y[worse] == 0).all() and set(worse) == set(np.flatnonzero(y == 0)) and set(better) == set(np.flatnonzero(y == 1))

    def loss(w):
        return np.log1p(np.exp(-(z[better] - z[worse]) @ w)).mean() + 1e-4 / 2 * w @ w

    w = np.array(model.weights)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-3
        assert loss(w) <= min(loss(w + step), loss(w - step)) + 1e-12
    s = z @ w
    assert (s < model.cut).sum() == (y == 0).sum() and ((model.scores(x) >= 0.7) == (s >= model.cut)).all()


def test_features_of_a_text_by_hand():
    named = dict(zip(quality.FEATURES, quality.features(b"Aa bb, bb!! 1 XYZ\n\nbb.")))
    assert named["log words"] == pytest.approx(math.log(7)) and named["words in upper case"] == pytest.approx(math.sqrt(1 / 6))
    assert named["words without letters"] == pytest.approx(math.sqrt(1 / 6)) and named["distinct words"] == 1.0
    assert named["digits"] == pytest.approx(math.sqrt(1 / 16)) and named["sentence ends"] == pytest.approx(math.sqrt(2 / 6))


def test_log_odds_have_the_shorter_stems_posterior_as_prior():
    rows = [("vil", 30, 2), ("vile$", 20, 0), ("kar", 3, 400), ("kara$", 2, 300), ("new$", 5, 5)]
    odds = toxicity.log_odds(rows, 100, 900)
    base = 100.5 / 1001
    first = (30 + 4 * base) / 36
    second = (20 + 4 * first) / 24
    logit = lambda p: math.log(p / (1 - p))
    assert odds["vil"] == pytest.approx(logit(first) - logit(base)) and odds["vile$"] == pytest.approx(logit(second) - logit(base))
    assert odds["kar"] == pytest.approx(max(-2, logit((3 + 4 * base) / 407) - logit(base))) and odds["kar"] < 0


def test_scores_of_long_and_repeated_texts(spark):
    docs, labels = toxic_corpus(400)
    long = " ".join(docs[1][1] for _ in range(20_000))
    rows = [*docs, (6000, long, None, None, 0, 0.0, None, 0), (6001, long + " vilestone vilesand grumble vilestone", None, None, 0, 0.0, None, 0), docs[0], docs[0]]
    table = spark.createDataFrame(labels, LABELS)
    toxic = toxicity.score(frame(spark, rows), toxicity.train(frame(spark, docs), table)).collect()
    good = quality.score(frame(spark, rows), quality.train(frame(spark, docs), table)).collect()
    for out in (toxic, good):
        assert len(out) == len(rows) and len({r.score for r in out if r.doc_id == docs[0][0]}) == 1
    by = {r.doc_id: r for r in toxic}
    assert by[6001].score > by[6000].score and any(p.first == 480_000 for p in by[6001].passages)


@pytest.mark.parametrize("name", ["quality classifier", "line dedup", "near-dedup", "mixing"])
def test_stages_keep_odd_rows_and_the_tables_own_columns(spark, sf_dir, name):
    import corpus_pipeline

    stage = dict(corpus_pipeline.STAGES)[name]
    rows = [(*r[:6], "mine", 17) for r in corpus()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, probability double, kept string, n_dropped long"
    more = {"n_lines": F.lit(5), "Topic": F.lit("x"), "score": F.lit(2.0), "n_tokens": F.lit("many"), "component_id": F.col("doc_id"), "n": F.lit(1)}
    docs = spark.createDataFrame(rows + rows[5:9], schema).withColumns(more).repartition(3)
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
    before = {(r.doc_id, r.text): r for r in docs.collect()}
    found = out.collect()
    for r in found:
        own = before.get((r.doc_id, r.text)) or next(x for (i, _), x in before.items() if i == r.doc_id)
        assert [r[c] for c in out.columns if c not in ("text", "n_chars")] == [own[c] for c in out.columns if c not in ("text", "n_chars")]
    if name == "line dedup":
        assert len(found) == docs.count() and all(r.n_chars == len(r.text) for r in found)
    if name == "near-dedup":
        ids = [r.doc_id for r in found if r.doc_id is not None]
        assert len(ids) == len(set(ids)) and sum(r.doc_id is None for r in found) == 1 and {33, 36, 39} <= set(ids)
    assert stage(spark, docs.where("false"), sf_dir).collect() == []


def test_every_query_has_its_columns_and_folds(spark, sf_dir):
    from quillmark.llm.queries import queries

    columns = {
        "op1_toxicity": {"doc_id", "held_out", "score", "predicted"}, "op2_lm_scoring": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
        "op3_near_dedup": {"doc_id", "n_shingles", "component_id", "kept"}, "op4_line_dedup": {"doc_id", "n_lines", "n_dropped", "kept_sha256"}, "op5_mixing": {"doc_id", "probability", "kept"},
        "op6_top_k": {"query_id", "rank", "vec_id", "score"}, "op7_token_shards": {"doc_id", "start", "n_tokens", "ids_crc32"}, "op8_embedding_dedup": {"vec_id", "n_links", "component_id", "kept"},
        "op9_quality": {"doc_id", "held_out", "score", "predicted"}, "op10_packing": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    }
    assert set(queries()) == set(columns)
    ids = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    for name, run in queries().items():
        out = run(spark, sf_dir)
        assert columns[name] <= set(out.columns)
        rows = out.collect()
        if "doc_id" in out.columns:
            assert {r.doc_id for r in rows} == ids
        if "predicted" in out.columns:
            cut = {"op1_toxicity": 0.3, "op9_quality": 0.7}[name]
            assert len(rows) == len(ids) and all(r.held_out == (crc32_of_id(r.doc_id) % 4 == 2) and r.predicted == (r.score >= cut) and 0 <= r.score <= 1 for r in rows)
        if name == "op2_lm_scoring":
            assert all(r.held_out == (crc32_of_id(r.doc_id) % 10 == 0) for r in rows) and len({r.train_tokens for r in rows}) == 1


def test_pipeline_stages_follow_brute_force(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from tests.llm.test_lines import brute as lines_brute
    from tests.llm.test_near import brute as near_brute
    from tests.llm.test_tokens import checked

    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    docs, rows = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near-dedup", "mixing", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text) for r in docs.collect()]
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        if name != "packing":
            assert docs.columns == columns
        found = {r.doc_id: r.text for r in rows} if name != "packing" else {}
        if name == "line dedup":
            assert found == {i: t for i, t, *_ in lines_brute(before)}
        elif name == "near-dedup":
            assert set(found) == {i for i, c in near_brute(before).items() if i == c}
        elif name == "packing":
            assert all(n & (n - 1) == 0 for n in checked(rows, before, 4096))
        else:
            assert 0 < len(found) < len(before) and all(found[i] == t for i, t in before if i in found)

