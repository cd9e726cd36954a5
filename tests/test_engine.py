import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.config import REPRESENTATIONS, FeatureConfig
from quillmark.functions import hashing, lexicon, scalars, tagger
from quillmark.functions import text as X
from quillmark.operators import ablation, documents, metrics, models, pairs, profiles, reports, routing, sampling, segments
from quillmark.sources import readers, writers


def sentences_frame(spark, texts):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, sent_idx int, sentence string")


def measured(spark, text, **more):
    return scalars.measured(sentences_frame(spark, [text]), [*scalars.GROUPS, "frequency"], **more).first().asDict()


def test_sentences_are_trimmed_lines(spark):
    docs = spark.createDataFrame([(1, "a\r\n\r\n b\t\rc\n\n"), (2, None), (3, ""), (4, "x y")], "doc_id long, text string")
    assert [(r.doc_id, r.sent_idx, r.sentence) for r in readers.sentences(docs).orderBy("doc_id", "sent_idx").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (4, 0, "x y")]
    assert readers.sentences(docs, breaks=X.WEB_LINE_BREAKS).where("doc_id = 4").count() == 2


def test_marks_and_layout(spark):
    m = measured(spark, 'Wait... no, ,  "WHAT"?! Sooo good.. (yes) don\'t')
    assert m["ellipsis_rate"] * 8 == pytest.approx(2) and m["period_rate"] == 0
    assert m["comma_rate"] * 8 == pytest.approx(2) and m["spacing_anomaly_rate"] > 0
    assert m["elongation_ratio"] > 0 and m["all_caps_word_ratio"] > 0 and m["contraction_ratio"] > 0
    assert m["starts_with_capital"] == 1 and m["ends_with_terminal"] == 0 and m["starts_with_dialogue"] == 0
    assert m["avg_word_freq_class"] == pytest.approx(1.0) and m["frequent_word_ratio"] == 0
    assert measured(spark, "3 Dogs ran!\"")["starts_with_capital"] == 0 and measured(spark, "3 dogs ran!\"")["ends_with_terminal"] == 1
    assert measured(spark, "and then", frequent=["then", "and"])["frequent_word_ratio"] == 1


def test_only_marks_give_no_nulls(spark):
    assert all(v is not None and math.isfinite(v) for v in measured(spark, "!!! ...").values())


@pytest.mark.parametrize("word,n", [("", 0), ("the", 1), ("table", 2), ("yellow", 2), ("walked", 1), ("wanted", 2), ("make", 1), ("agree", 2), ("rhythm", 1), ("beautiful", 3), ("don't", 1)])
def test_syllables(spark, word, n):
    assert spark.range(1).select(X.syllables(F.lit(word)).alias("n")).first().n == n


def test_function_words_split_contractions(spark):
    s = scalars.prepared(sentences_frame(spark, ["I won't, they'll be the dog's"]))
    found = {r.word for r in profiles.function_words(s, "doc_id", "sent_idx").collect()}
    assert {"i", "will", "n't", "they", "'ll", "be", "the"} <= found


def test_selections_and_sweeps(spark):
    from quillmark.operators import features

    names = features.pair_names(FeatureConfig())
    chosen = ablation.selections(names, ablation.groups())
    assert chosen[0].columns == tuple(names) and len(chosen) == 1 + 2 * 18
    by = {s.name: s.columns for s in chosen}
    assert by["ONLY TFIDF"] == ("abs_mean_tfidf",) and by["ONLY LENGTH"] == ("abs_log_word_count", "abs_log_char_count", "overall_distance")
    assert len(by["ALL - LENGTH"]) == 74
    table = ablation.study(chosen[:2], lambda cols, seed: len(cols) + seed, (1, 2))
    assert table[0][1:] == (2, 76 + 1.5, pytest.approx(math.sqrt(0.5)))
    rows = spark.createDataFrame([(3.0, 4.0, 9.0, 1)], "abs_log_word_count double, abs_log_char_count double, overall_distance double, label int")
    assert ablation.selected(rows, ablation.Selection("ONLY LENGTH", by["ONLY LENGTH"])).first().overall_distance == pytest.approx(math.sqrt(12.5))
    assert ablation.with_baseline((0.1, 0.3), 0.2) == [0.1, 0.2, 0.3] and ablation.with_baseline(("a",), "b") == ["a", "b"] and ablation.thinned([1, 2, 3, 4, 5]) == [1, 3, 5]
    assert len(ablation.variants()) == 50 and len(ablation.retrieval_variants()) == 36 and len({x[2] for x in ablation.retrieval_variants()}) > 33


def test_ablation_runs(spark):
    rng = np.random.default_rng(8)
    rows = [(d, i, routing.LEVELS[d % 3], int(y), float(y + rng.normal() / 2), float(rng.normal())) for d in range(60) for i in range(5) for y in [rng.integers(0, 2)]]
    pairs_ = spark.createDataFrame(rows, "doc_id long, sent_idx int, level string, label int, abs_a double, abs_b double").persist()
    data = ablation.Data(pairs_.where("doc_id < 40"), pairs_.where("doc_id BETWEEN 40 AND 49"), pairs_.where("doc_id >= 50"), ("abs_a", "abs_b"))
    runs = ablation.Runs(data)
    for s in ablation.selections(data.columns, {"A": ("abs_a",), "B": ("abs_b",)})[:2]:
        runs.add("features", "logistic", s.name, selection=s)
    runs.add("features", "logistic", "ALL again", selection=ablation.Selection("ALL", data.columns))
    runs.add("parameters", "tree", "max_depth=2", ablation.Parameters(max_depth=2))
    runs.add("parameters", "neural", "small", ablation.Parameters(hidden_layers=(4,), epochs=5))
    assert len(runs.known) == 4 and runs.table[0]["test_macro_f1_mean"] > 0.7 > runs.table[1]["test_macro_f1_mean"]
    assert {"pooled_easy_mean", "tuned_hard_mean", "threshold_mean"} <= set(runs.table[3])


SENTENCES = ["I won't go there.", "The old house was sold, wasn't it?", "NO WAY!!! Really...", "x", "And so, they walked slowly to the building; it rained."]


def labelled(spark):
    return spark.createDataFrame([(d, i, t, None if i == 0 else (i + d) % 2) for d in (1, 2) for i, t in enumerate(SENTENCES[d - 1 :])], "doc_id long, sent_idx int, sentence string, change int")


def test_groups_cover_all_scalars_and_blocks():
    from quillmark.operators import features

    assert len(features.GROUPS) == 18 and len(features.SCALARS) == len(set(features.SCALARS)) == 63
    config = FeatureConfig()
    assert features.blocks(config) == {"char3": 256, "pos2": 128, "fw": 214} and len(features.pair_names(config)) == 76
    owned = [c for g in features.GROUPS for c in features.pair_columns(g, config)]
    assert sorted([*owned, features.OVERALL]) == sorted(features.pair_names(config))
    assert features.groups_of("readability") == ["FLESCH_READING_EASE", "GUNNING_FOG", "FLESCH_KINCAID"] and len(features.families()) == 7
    assert "76 columns" in features.describe(config)


def test_pair_matrix(spark):
    from dataclasses import replace

    from quillmark.operators import features

    config = FeatureConfig(char_buckets=16, pos_buckets=8, full=True, casing="hybrid")
    matrix, extractor = features.training_matrix(labelled(spark), config=config, frequent=["the", "and"])
    assert matrix.columns == ["doc_id", "sent_idx", "label", *features.pair_names(config)]
    rows = matrix.orderBy("doc_id", "sent_idx").collect()
    assert [r.label for r in rows] == [(i + d) % 2 for d in (1, 2) for i in range(1, 6 - d)]
    vectors = spark.createDataFrame(extractor.vectors(labelled(spark), "change").collect())
    v = vectors.orderBy("doc_id", "sent_idx").collect()
    x = np.array([[r[c] for c in features.SCALARS] for r in v])
    z = np.clip((x - x.mean(0)) / np.where(x.std(0) < 1e-12, 1, x.std(0)), -5, 5)
    at = [0, 1, 2, 3, 5, 6, 7]
    assert [r[features.OVERALL] for r in rows] == pytest.approx(np.sqrt(((z[1:] - z[:-1]) ** 2).mean(1))[at].tolist())
    assert [r.abs_comma_rate for r in rows] == pytest.approx(np.abs(z[1:] - z[:-1])[at][:, features.SCALARS.index("comma_rate")].tolist())
    gaps = np.array([r.diff_char3 for r in rows])
    assert gaps.shape == (7, 16) and np.abs(gaps.mean(0)).max() < 1e-6 and all(r.char3_js_distance <= 1 for r in rows)
    for representation, value in (("CONCAT", z[at, 0]), ("RELATIVE", (np.abs(x[1:] - x[:-1]) / (np.abs(x[1:]) + np.abs(x[:-1]) + 1e-8))[at, 0])):
        extractor.config = replace(config, representation=representation, full=False)
        found = extractor.pairs(vectors, "change").orderBy("doc_id", "sent_idx").collect()
        assert [r[3] for r in found] == pytest.approx(value.tolist())


def test_tagger_by_rule():
    tags = tagger.tag("The old man walked slowly to the house .".split())
    assert [tagger.TAGS[t] for t in tags] == ["det", "adj", "noun", "verb", "adv", "part", "det", "noun", "punct"]
    assert [tagger.TAGS[t] for t in tagger.tag(["Paris", "isn't", "it's", "Rome's", "3.5", "wow", "Berlin"])] == ["noun", "aux", "pron", "propn", "num", "intj", "propn"]
    assert tagger.tag([]) == [] and tagger.tag(["The", "slowly", "house"]) == [tagger.DET, tagger.ADV, tagger.NOUN]
    said = tagger.tag("— We run . The run in the Building was stopped , let's hurry ; dogs' n't Ünïted".split())
    assert [tagger.TAGS[t] for t in said] == ["punct", "pron", "verb", "punct", "det", "noun", "adp", "det", "noun", "aux", "verb", "punct", "verb", "noun", "punct", "noun", "aux", "propn"]
    own = tagger.tagger(verbs=["zib"], adjectives=[])
    assert own.tag(["they", "zibbed", "good"]) == [tagger.PRON, tagger.VERB, tagger.NOUN]
    with pytest.raises(ValueError):
        tagger.tagger("corenlp")
    assert [tagger.TAGS[tagger.from_penn(x)] for x in ("NNS", "VBD", "PRP$", "-LRB-", ",", "FW", "HYPH", "POS", None)] == ["noun", "verb", "pron", "punct", "punct", "other", "punct", "part", "other"]


def test_profiles_by_hand(spark):
    texts = ["ab, cd", "", "a", "ünï x-y 12"]
    for n, buckets, typed in ((3, 16, False), (2, 8, True), (1, 4, False)):
        rows = profiles.char_profile(sentences_frame(spark, texts), n, buckets, typed).orderBy("sent_idx").collect()
        for r in rows:
            counts, t = [0] * buckets, r.sentence
            for i in range(len(t) - n + 1):
                g = t[i : i + n]
                edge = i == 0 or i + n == len(t) or not t[i - 1].isalnum() or not t[i + n].isalnum()
                if not typed or edge or not g.isalnum():
                    counts[int(hashing.buckets_of(hashing.gram_hashes(hashing.units_of(g), n), buckets)[0])] += 1
            assert r.profile == pytest.approx([c / max(1, sum(counts)) for c in counts])
    tagged = spark.createDataFrame([(1, 0, [0, 2, 0]), (1, 1, []), (1, 2, None)], "doc_id long, sent_idx int, tags array<int>")
    one = {r.sent_idx: r.profile for r in profiles.tag_profile(tagged, 1, 15).collect()}
    assert one[0][:3] == pytest.approx([2 / 3, 0, 1 / 3]) and sum(one[1]) == sum(one[2]) == 0
    two = {r.sent_idx: r.profile for r in profiles.tag_profile(tagged, 2, 64).collect()}
    assert sum(two[0]) == pytest.approx(1) and sum(v > 0 for v in two[1]) == 1 and two[1] == two[2]
    fw = profiles.function_word_profile(scalars.prepared(sentences_frame(spark, ["The dog won't", "xyz", "the the"])).withColumn("__fw", profiles.function_word_parts())).orderBy("sent_idx").collect()
    assert len(fw[0].fw) == 214 and sum(fw[0].fw) == pytest.approx(1) and sum(fw[1].fw) == 0 and fw[2].fw[0] == 1


def test_profiles_sum_to_one_and_distances_are_symmetric(spark):
    s = sentences_frame(spark, ["the quick brown fox", "a slow, grey dog!", "ab", "the quick brown fox"])
    p = profiles.char_profile(s, 3, 16)
    sums = {r.sent_idx: sum(r.profile) for r in p.collect()}
    assert sums[0] == pytest.approx(1) and sums[2] == 0
    rows = {r.sent_idx: r.profile for r in p.collect()}
    pairs_ = spark.createDataFrame([(a, b, rows[a], rows[b]) for a in range(4) for b in range(4)], "a int, b int, p array<double>, q array<double>")
    d = {(r.a, r.b): r for r in pairs_.select("a", "b", *[v.alias(k) for k, v in profiles.distances(F.col("p"), F.col("q")).items()]).collect()}
    assert d[0, 1].js_distance == pytest.approx(d[1, 0].js_distance) and d[0, 3].cosine == pytest.approx(1) and d[0, 3].js_distance == pytest.approx(0, abs=1e-7)
    assert (d[0, 2].cosine, d[0, 2].js_distance, d[0, 2].total_variation, d[0, 2].jaccard) == (0, 1, 1, 0)


def test_hashes_by_hand():
    h = 2166136261
    for c in "abc":
        h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
    h ^= h >> 16
    h = h * 0x85EBCA6B & 0xFFFFFFFF
    h ^= h >> 13
    h = h * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    assert hashing.gram_hashes(hashing.units_of("abc"), 3).tolist() == [h]
    assert documents.string_hash("hello") == 99162322


def scored(spark, rows):
    return spark.createDataFrame(rows, "level string, score double, label int")


def test_metrics_by_hand(spark):
    s = scored(spark, [("a", 0.9, 1), ("a", 0.8, 0), ("a", 0.2, 0), ("a", 0.1, 0)])
    m = metrics.confusion(s, "level").first()
    assert m.macro_f1 == pytest.approx(11 / 15) and m.f1_change == pytest.approx(2 / 3) and m.balanced_accuracy == pytest.approx(5 / 6)
    auc = lambda ps, ys: metrics.auc(scored(spark, [("a", p, y) for p, y in zip(ps, ys)]), "level").first().auc
    assert auc([0.1, 0.6, 0.4, 0.9], [0, 0, 1, 1]) == 0.75 and auc([0.5] * 4, [0, 0, 1, 1]) == 0.5 and auc([0.5], [1]) == 0.5
    counts = spark.createDataFrame([(3, 3), (5, 4), (2, 4), (7, 0)], "estimated int, authors int")
    r = metrics.author_counts(counts).first()
    assert (r.documents, r.exact, r.mae, r.signed) == (3, pytest.approx(1 / 3), 1, pytest.approx(-1 / 3))


def test_best_threshold_is_the_plateaus_middle(spark):
    s = scored(spark, [("a", 0.2, 0), ("a", 0.6, 1)])
    best = metrics.best_threshold(s, "level").first()
    assert best.threshold == pytest.approx((40 + 119) / 400) and best.best == 1


def test_segments(spark):
    s = spark.createDataFrame([(1, i, c) for i, c in enumerate([None, 0, 1, 0, 0, 1])], "doc_id long, sent_idx int, change int")
    parts = segments.segments(segments.segment_ids(s)).orderBy("first").collect()
    assert [(r["first"], r.end) for r in parts] == [(0, 2), (2, 5), (5, 6)]
    rel = lambda *x: spark.range(1).select(segments.author_relation(*map(F.lit, x)).alias("r")).first().r
    assert [rel(0, 1, 5, 3), rel(0, 2, 5, 5), rel(0, 2, 5, 2), rel(0, 3, 5, 2), rel(0, 2, 5, 3)] == ["different", "different", "same", "different", "unknown"]


def test_pairs_keep_documents_apart(spark):
    v = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.0)], "doc_id long, sent_idx int, x double")
    assert [(r.doc_id, r.a_x, r.b_x) for r in pairs.neighbours(v, ["x"]).collect()] == [(1, 1.0, 3.0)]
    assert pairs.fit_scaler(v.where("doc_id = 2"), ["x"])["x"] == (5.0, 1.0)
    with pytest.raises(ValueError):
        pairs.represented("x", "OTHER")
    assert all(pairs.represented("x", r) for r in REPRESENTATIONS)
    with pytest.raises(ValueError):
        FeatureConfig(char_buckets=1)
    assert FeatureConfig().signature() != FeatureConfig(casing="lower").signature()


def test_samples(spark):
    assert sampling.java_shuffle(list(range(10)), 42) == [4, 6, 2, 1, 7, 9, 8, 5, 3, 0]
    assert sampling.within_budget([(1, 5), (2, 6), (3, 4), (4, 1)], 10) == [1, 3, 4]
    halves = sampling.halves(spark.range(101).select(F.col("id").alias("doc_id"), F.lit("x").alias("lang")), "lang")
    assert {r.half: r["count"] for r in halves.groupBy("half").count().collect()} == {1: 51, 2: 50}


def numeric(net, loss):
    worst = 0.0
    _, grads = loss()
    for p, g in zip(net.parameters(), grads):
        for at in list(np.ndindex(p.shape))[:6]:
            kept = p[at]
            p[at] = kept + 1e-5
            up = loss()[0]
            p[at] = kept - 1e-5
            down = loss()[0]
            p[at] = kept
            worst = max(worst, abs((up - down) / 2e-5 - g[at]))
    return worst


def test_gradients():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(30, 5)), (rng.random(30) > 0.5).astype(float)
    net = models.Network.start([5, 7, 4, 1])
    assert numeric(net, lambda: models.binary_loss(net, x, y, np.ones(30), 1e-3)) < 1e-5
    emb = models.Network.start([5, 6, 3])
    assert numeric(emb, lambda: models.triplet_loss(emb, x[:10], x[10:20], x[20:], 0.5)) < 1e-4


def test_networks_learn_and_round_trip(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    net = models.fit_network(x, y, hidden=(16,), epochs=30, drop=0.0)
    rows = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y)], "a double, b double, c double, label int")
    out = models.apply_network(rows, net, ["a", "b", "c"]).collect()
    assert np.mean([(r.score > 0.5) == r.label for r in out]) > 0.93
    models.save(spark, str(tmp_path / "m"), models.Saved("neural", 0.5, "sig", ["a", "b", "c"]), net)
    meta, again = models.load(spark, str(tmp_path / "m"))
    assert meta.threshold == 0.5 and all(np.allclose(p, q) for p, q in zip(net.parameters(), again.parameters()))
    old = json.loads(spark.read.text(str(tmp_path / "m" / "meta")).first().value) | {"format": 0}
    spark.createDataFrame([(json.dumps(old),)], "value string").write.mode("overwrite").text(str(tmp_path / "m" / "meta"))
    with pytest.raises(ValueError):
        models.load(spark, str(tmp_path / "m"))
    assert models.valid(rows, ["a", "b"]) and not models.valid(rows.withColumn("a", F.lit(float("nan"))), ["a", "b"])


def test_triplets_follow_the_policy():
    rows = [(d, s, 100 * d + 3 * s + k) for d in (0, 1) for s in range(4) for k in range(3)]
    place = {r: (d, s) for d, s, r in rows}
    for a, p, *n in models.draw_triplets(rows, 50):
        assert a != p and place[a] == place[p] and all(place[x][0] == place[a][0] and abs(place[x][1] - place[a][1]) == 1 for x in n)
    far = crossed = 0
    for a, p, *n in models.draw_triplets(rows, 200, models.TripletPolicy(3, 0.5, True, 0.5), {0: 2, 1: 4}):
        (d, s), (e, t) = place[a], place[p]
        assert d == e and (s - t) % 2 == 0 and (d == 0 or s == t)
        far += s != t
        for x in n:
            crossed += place[x][0] != d
            assert place[x][0] != d or models.relation_of(s, place[x][1], 4, {0: 2, 1: 4}[d]) == "different"
    assert far > 10 and crossed > 200
    assert models.draw_triplets([(0, 0, 0), (0, 1, 1)], 5).shape == (0, 6)


def test_embedding_learns_and_sees_every_triplet():
    rng = np.random.default_rng(4)
    author = rng.integers(0, 2, 200)
    x = rng.normal(size=(200, 6))
    x[:, 0] += 2.5 * author
    ones, zeros = np.flatnonzero(author == 1), np.flatnonzero(author == 0)
    t = np.array([[a, rng.choice(ones if author[a] else zeros), *rng.choice(zeros if author[a] else ones, 4)] for a in range(200)])
    start = models.triplet_evaluation(models.Network.start([6, 16, 4]), x, t[150:])
    net = models.fit_embedding(x, t[:150], (16,), 4, epochs=15, held=(x, t[150:]))
    loss, right = models.triplet_evaluation(net, x, t[150:])
    assert loss < start[0] and right > max(start[1], 0.7)
    near = models.hardest(net, x, t[:5])
    e = models.unit(net.forward(x)[0])
    assert all((e[a] @ e[n]) >= max(e[a] @ e[c] for c in cs) - 1e-12 for n, (a, _, *cs) in zip(near, t[:5]))
    assert np.linalg.norm(models.random_units(5, 3), axis=1) == pytest.approx(np.ones(5)) and (models.random_units(5, 3) == models.random_units(5, 3)).all()


def test_tree_is_explained_and_models_come_back(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 2))
    y = ((x[:, 0] > 0.3) & (x[:, 1] < 0.5)).astype(int)
    rows = spark.createDataFrame([(int(i), float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id int, a double, b double, label int")
    model = models.fit_tree(rows, ["a", "b"], depth=3)
    tree = models.nodes(model, ["a", "b"])
    leaves = [n for n in tree if n.column is None]
    assert len(models.rules(tree)) == len(leaves) and set(models.splits(tree)) == {"a", "b"}
    scored_ = {r.id: r.score for r in models.score(rows, model, ["a", "b"]).collect()}
    for r in models.explained(rows, models.nodes(model, ["a", "b"], prune=False)).collect():
        assert float(r.path[-1].split()[-1]) == pytest.approx(scored_[r.id], abs=6e-4) and all(("<=" in p) or (">" in p) for p in r.path[:-1])
    for kind, fitted in (("tree", model), ("logistic", models.fit_logistic(rows, ["a", "b"]))):
        models.save(spark, str(tmp_path / kind), models.Saved(kind, 0.4, "s", ["a", "b"]), model=fitted)
        meta, again = models.load(spark, str(tmp_path / kind))
        assert {r.id: r.score for r in models.change_scores(rows, again, meta.columns).collect()} == {r.id: r.score for r in models.change_scores(rows, fitted, ["a", "b"]).collect()}
    assert models.resolved(spark, str(tmp_path))[0] == "logistic"
    with pytest.raises(ValueError):
        models.resolved(spark, str(tmp_path), ("neural",))
    setting, _, results = models.grid_search(lambda d: models.fit_tree(rows, ["a", "b"], depth=d), lambda m: metrics.confusion(models.score(rows, m, ["a", "b"])).first().macro_f1, [1, 2, 4], 0.005)
    assert setting == 2 and len(results) == 3
    assert models.impurity([1, 1]) == 0.5 and models.impurity([1, 1], "entropy") == pytest.approx(math.log(2)) and models.impurity([]) == 0
    base = models.baselines(rows).first()
    assert base.ones == y.sum() and base.always_0 == pytest.approx((300 - y.sum()) / (2 * (300 - y.sum()) + y.sum()))
    assert {r.column: round(r["mean"], 9) for r in models.feature_summary(rows, ["a", "b"]).collect()} == {"a": round(x[:, 0].mean(), 9), "b": round(x[:, 1].mean(), 9)}


def two_authors(spark, first, n):
    """Documents in which two authors of different habits take turns."""
    rng = np.random.default_rng(first)
    rows = []
    for d in range(first, first + n):
        author, at = 0, 0
        for turn in range(4):
            for _ in range(int(rng.integers(1, 4))):
                words = [str(rng.choice(["go", "we", "it", "so"] if author == 0 else ["notwithstanding", "considerable", "arrangement"])) for _ in range(rng.integers(3, 9))]
                rows.append((d, at, " ".join(words) + ("!" if author == 0 else "; indeed."), None if at == 0 else int(rows[-1][5] != author), 2, author))
                at += 1
            author = 1 - author
    return spark.createDataFrame([r[:5] for r in rows], "doc_id long, sent_idx int, sentence string, change int, authors int")


def test_retrieval_pipeline(spark):
    from quillmark.operators import retrieval

    config = FeatureConfig(char_buckets=8, pos_orders=(), function_word_profile=False)
    result = retrieval.run(two_authors(spark, 0, 12), two_authors(spark, 100, 6), None, retrieval.Settings(config, (8,), 4, epochs=4, triplets=300, windows=(1,)))
    assert set(result.measures) == {"learned", "raw", "random"} and result.window == 1
    assert result.measures["learned"]["macro_f1"] > 0.9 > result.measures["random"]["auc"]


def test_levels(spark):
    from quillmark.operators import levels

    rng = np.random.default_rng(1)
    docs = []
    for d in range(90):
        level = routing.LEVELS[d % 3]
        docs.append((d, "\n".join(" ".join(str(rng.choice(["garden", "violin", "river", "table"])) for _ in range(3 + 6 * (d % 3))) + "." for _ in range(2 + 4 * (d % 3) + rng.integers(0, 2))), level))
    docs = spark.createDataFrame(docs, "doc_id long, text string, level string")
    detector = levels.fit(docs)
    found = docs.join(detector.probabilities(docs), "doc_id")
    table = {r.level: r for r in levels.confusion(found).collect()}
    assert all(table[k][k] >= 28 for k in routing.LEVELS)
    means = {r.level: r.log_sentences for r in levels.mean_numbers(docs).collect()}
    assert means["easy"] < means["medium"] < means["hard"]
    scored_ = docs.select("doc_id", F.explode(F.array(*[F.struct(F.lit(s).alias("score"), F.lit(y).alias("label")) for s, y in ((0.3, 1), (0.1, 0))])).alias("x")).select("doc_id", "x.*")
    got = {(r.scheme, r.level): r.macro_f1 for r in levels.schemes(scored_, found, {"easy": 0.2, "medium": 0.2, "hard": 0.9}, 0.2).collect()}
    assert got["pooled", "all"] == got["true", "easy"] == 1 and got["true", "hard"] == pytest.approx(1 / 3) and len(got) == 16
    assert levels.routed_models({"tree": {"easy": 0.1}, "neural": dict.fromkeys(routing.LEVELS, 0.5)}) == {"neural": dict.fromkeys(routing.LEVELS, 0.5)}


def test_routing(spark):
    docs = spark.createDataFrame([(1, [0.1, 0.8, 0.1]), (2, [0.2, 0.2, 0.6]), (3, [0.1, 0.7, 0.2])], "doc_id long, probabilities array<double>")
    assert routing.dataset_vote(docs).first().level == "medium"
    by = {"easy": 0.1, "medium": 0.2}
    assert {r.doc_id: r.threshold for r in routing.thresholds(docs, by, 0.5).collect()} == {1: 0.2, 2: 0.5, 3: 0.2}
    assert {r.threshold for r in routing.thresholds(docs, by, 0.5, "easy").collect()} == {0.1}
    scored_ = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.2)], "doc_id long, sent_idx int, score double")
    out = {r.doc_id: json.loads(r.solution) for r in routing.solutions(docs, routing.decisions(scored_, routing.thresholds(docs, by, 0.5))).collect()}
    assert out == {1: {"changes": [0, 1]}, 2: {"changes": []}, 3: {"changes": []}}


def test_service(spark):
    from quillmark.operators import features, service

    config = FeatureConfig(char_buckets=8, pos_buckets=8)
    train = two_authors(spark, 0, 8)
    matrix, extractor = features.training_matrix(train.select("doc_id", "sent_idx", "sentence", "change"), config=config)
    columns = features.pair_names(config)
    own = spark.createDataFrame(matrix.collect())
    tree = service.Service(extractor, models.fit_tree(own, columns, depth=2), 0.5, None, {"easy": 0.1})
    texts = spark.createDataFrame(two_authors(spark, 50, 2).collect())
    truth = texts.where("change IS NOT NULL").select("doc_id", (F.col("sent_idx") - 1).alias("sent_idx"), F.col("change").alias("label"))
    out = tree.predict(texts.drop("change"), truth=truth)
    assert out["measures"].first().macro_f1 > 0.8 and {r.outcome for r in out["pairs"].collect()} <= {"TP", "TN", "FP", "FN"}
    assert {r.reason for r in out["documents"].collect()} == {"pooled: no level detector"} and tree.reason("none") == "pooled threshold asked" and tree.reason(0.3) == "given threshold"
    assert out["segments"].count() >= 2 and all(json.loads(r.solution)["changes"] for r in out["solutions"].collect())
    assert tree.chance(spark, "we go so!", "notwithstanding considerable; indeed.") > 0.5
    assert set(tree.pair_features(spark, "a b", "c")) == set(columns)
    parts = tree.analyse(texts)
    assert len(parts["summary"].collect()) == 2 * 63 and sum(r.words for r in parts["segments"].collect()) > 20
    seen = service.inspect(texts.select("doc_id", "sent_idx", "sentence"), extractor)
    assert seen["pairs"].count() == texts.count() - 2 and set(features.SCALARS) < set(seen["standardized"].columns)
    net = models.Network.start([63 + 8 + 8 + 214, 4])
    near = service.retrieve(texts, net, extractor, k=2, dim=4)
    assert near["nearest"].count() == 2 * texts.count() and near["boundaries"].columns == ["doc_id", "sent_idx", "score"]


def test_small_columns(spark):
    from quillmark.operators import service

    r = spark.createDataFrame([(0.0005, -0.0005, [0, 1], [0, 2], 3)], "a double, b double, good array<int>, bad array<int>, n int")
    got = r.select(service.shown(F.col("a")), service.shown(F.col("b")), service.valid_truth(F.col("good"), F.col("n")), service.valid_truth(F.col("bad"), F.col("n")), service.valid_truth(F.lit(None).cast("array<int>"), F.col("n")), X.letters_only(F.lit("It's 3 O'Clock"))).first()
    assert tuple(got) == (0.001, 0.0, True, False, False, "itsoclock")
    s = spark.createDataFrame([(1, 0), (1, 1), (1, 2), (2, 0)], "doc_id long, sent_idx int")
    assert sorted((r.doc_id, r.position) for r in service.with_positions(s).collect()) == [(1, 0.0), (1, 0.5), (1, 1.0), (2, 0.0)]
    seg = spark.createDataFrame([(1, 0, 2), (1, 1, 3), (2, 0, 1)], "doc_id long, segment int, sentences long")
    assert sorted((r.doc_id, r.segment, r.segments, r.start) for r in segments.offsets(seg).collect()) == [(1, 0, 2, 0), (1, 1, 2, 2), (2, 0, 1, 0)]


def test_problem_folders(spark, tmp_path):
    for level in ("easy", "hard"):
        for split in ("train", "validation"):
            folder = tmp_path / level / split
            folder.mkdir(parents=True)
            for n in (1, 2, 10):
                (folder / f"problem-{n}.txt").write_text("One.\nTwo.\nThree.")
                (folder / f"truth-problem-{n}.json").write_text('{"authors": 2, "changes": [1, 0]}')
    root = str(tmp_path)
    assert readers.problem_ids(spark, root, "train", "easy") == ["1", "10", "2"]
    good, _ = readers.problems(spark, root, "validation", "hard", casing="lower")
    assert {(r.level, r.split, r.sentences[0]) for r in good.collect()} == {("hard", "validation", "one.")} and good.count() == 3
    counts = [readers.problems(spark, root, "train", part=p)[0].groupBy("level").count().collect() for p in ("first", "second")]
    assert [{r.level: r["count"] for r in c} for c in counts] == [{"easy": 2, "hard": 2}, {"easy": 1, "hard": 1}]
    pairs_ = readers.labelled_pairs(good).orderBy("doc_id", "sent_idx").collect()
    assert len(pairs_) == 6 and (pairs_[0].first, pairs_[0].second, pairs_[0].label) == ("one.", "two.", 1)
    assert readers.unlabelled(spark, root, "train").count() == 18
    with pytest.raises(ValueError):
        readers.active("easy,odd")
    rows = spark.createDataFrame([("1", '{"changes":[1]}', "hard/a"), ("2", '{"changes":[]}', "easy")], "doc_id string, solution string, folder string")
    for _ in range(2):
        writers.solutions(rows, str(tmp_path / "out"))
    assert (tmp_path / "out" / "hard" / "a" / "solution-problem-1.json").read_text() == '{"changes":[1]}' and len(list((tmp_path / "out" / "easy").glob("*.json"))) == 1
    books = spark.createDataFrame([(a, i, f"{a} {i}") for a in ("x", "y", "z") for i in range(40)], "author string, sent_idx int, sentence string")
    made = readers.synthetic_problems(books, 20).collect()
    assert len({r.doc_id for r in made}) == 20
    for d in range(20):
        lines = sorted((r.sent_idx, r.sentence.split()[0], r.change) for r in made if r.doc_id == d)
        assert [i for i, *_ in lines] == list(range(len(lines))) and len({a for _, a, _ in lines}) == 2
        assert [c for *_, c in lines[1:]] == [int(a[1] != b[1]) for a, b in zip(lines, lines[1:])]


def test_files_round_trip(spark, tmp_path):
    root = tmp_path / "data" / "easy" / "train"
    root.mkdir(parents=True)
    (root / "problem-1.txt").write_text("One.\nTwo.\n")
    (root / "truth-problem-1.json").write_text('{"authors": 2, "changes": [1]}')
    (root / "problem-2.txt").write_text("One.\nTwo.\n")
    (root / "truth-problem-2.json").write_text('{"changes": [1, 0]}')
    (root / "problem-3.txt").write_text("One.\n")
    good, bad = readers.problems(spark, str(tmp_path / "data"))
    assert [(r.doc_id, r.level, r.split, r.authors, r.changes) for r in good.collect()] == [("1", "easy", "train", 2, [1])]
    assert {(r.doc_id, r.reason) for r in bad.collect()} == {("2", "lengths differ"), ("3", "no truth")}
    writers.levels(spark, str(tmp_path / "levels"), {"easy": 0.25, "hard": 0.5}, "by level")
    assert readers.levels(spark, str(tmp_path / "levels")) == {"easy": 0.25, "hard": 0.5}
    log = str(tmp_path / "log")
    assert [writers.append_metrics(spark, log, {"modelName": "tree", "f1": x}) for x in (0.1, 0.2)] == [1, 2]
    assert readers.metrics(spark, log).count() == 2
    (tmp_path / "words.txt").write_text("the\nof\nThe\nand\n")
    assert {r.word: r["rank"] for r in lexicon.read_frequent_words(spark, str(tmp_path / "words.txt")).collect()} == {"the": 1, "of": 2, "and": 3}
    (tmp_path / "emotions.txt").write_text("abandon\tfear\t1\nabandon\tjoy\t0\nabandon\tother\t1\nbad line\n")
    r = lexicon.read_emotions(spark, str(tmp_path / "emotions.txt")).first()
    assert (r.word, r.fear, r.joy, r.anger) == ("abandon", 1, 0, 0)


def test_reports(spark):
    runs = spark.createDataFrame([("m", "ALL", 0.7, 0.0), ("m", "ALL - X", 0.6, 0.01)], "model string, experiment string, macro_f1 double, sd double")
    assert [(r.experiment, round(r.importance, 6), r.verdict) for r in reports.importances(runs).collect()] == [("ALL - X", 0.1, "helps")]


def test_report_tables(spark):
    rows = [("t", "ALL", 0.7, 0.9, 5, 1), ("t", "ALL - X", 0.6, 0.85, 5, 2), ("n", "ALL", 0.8, 0.9, 10, 1), ("n", "ALL - X", 0.78, 0.95, 10, 2)]
    runs = spark.createDataFrame(rows, "model string, experiment string, macro_f1 double, easy double, depth int, leaf int")
    assert [(r.experiment, r.models, round(r.macro_f1, 6), round(r.easy, 6)) for r in reports.importance_by_level(runs, "macro_f1", "easy").collect()] == [("ALL - X", 2, 0.06, 0.0)]
    assert {r.experiment: (r.t, r.n, round(r["mean"], 6)) for r in reports.across_models(runs, ("t", "n")).collect()} == {"ALL": (0.7, 0.8, 0.75), "ALL - X": (0.6, 0.78, 0.69)}
    assert {r.depth: (r["1"], r["2"]) for r in reports.grid(runs, "depth", "leaf", (1, 2)).collect()} == {5: (0.7, 0.6), 10: (0.8, 0.78)}
    assert reports.markdown(runs.where("model = 't'").select("model", "macro_f1").limit(1)) == "| model | macro_f1 |\n|---|---|\n| t | 0.7000 |"
    log = spark.createDataFrame([(1, "tree", "2024-01-01"), (2, "tree", "2024-02-01"), (3, "neural", "2024-03-01")], "id int, model string, trained_at string")
    assert [r.id for r in reports.history(log, "tree").collect()] == [2, 1] and reports.latest_for(log, "tree").first().id == 2


def test_stream_equals_table(spark, sf_dir, tmp_path):
    from quillmark.streaming import documents as streams

    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(20).coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    source = streams.read_documents(spark, str(tmp_path / "in" / "a"))
    q = streams.measured(source, ["length"]).writeStream.format("memory").queryName("measured").outputMode("append").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    table = streams.measured(spark.read.parquet(str(tmp_path / "in" / "a")), ["length"])
    assert spark.table("measured").exceptAll(table).isEmpty() and table.count() == spark.table("measured").count()
