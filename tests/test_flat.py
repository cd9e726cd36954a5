"""The measurements over arrays against regular expressions, sentence by sentence, and what their plans don't have."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from quillmark.functions import flat, scalars
from quillmark.plans import catalog

ODD = ["", "x", " a  b ", "I won't, they'll be the DOG'S", "...!!! ?? ,,", "Sooo looong— “quoted” …", "'' ' 'a a'", "日本語 Ünï 12½ ١٢", "e. \x0b e E", "a-a-a AAA aaa", "’tis 😀, no;yes", " . ", "1st 2nd"]


def texts():
    rng = random.Random(3)
    return ODD + ["".join(rng.choice("aAeEyldsnt''’  ..,;!?-—()\"1é\t😀") for _ in range(rng.randrange(60))) for _ in range(300)]


def plan(query, spark, sf_dir):
    return catalog.queries()[query](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def by_rule(t: str) -> dict[str, float]:
    t = t.replace("’", "'")
    tokens = re.split("[ \t\n\x0b\f\r]+", t) if t else []
    w = [x for x in (re.sub("[^a-zA-Z0-9']", "", x) for x in tokens) if x]
    lw = [x.lower() for x in w]
    n, per_token, per_char = max(1, len(w)), max(1, len(tokens)), max(1, len(t))
    found = {c: lw.count(c) for c in lw}
    return {
        "n_words": len(tokens), "n_w": len(w), "avg_word_length": sum(c.isalpha() for c in t) / per_token, "type_token_ratio": len(found) / n, "hapax_ratio": sum(c == 1 for c in found.values()) / n,
        "wl_3_4": sum(3 <= len(x.replace("'", "")) <= 4 for x in w) / n, "comma_rate": t.count(",") / per_token, "period_rate": sum(len(x) == 1 for x in re.findall(r"\.+", t)) / per_token,
        "ellipsis_rate": (sum(len(x) > 1 for x in re.findall(r"\.+", t)) + t.count("…")) / per_token, "repeated_punct_rate": len(re.findall(r"!{2,}|\?{2,}|,{2,}|;{2,}|:{2,}", t)) / per_token,
        "all_caps_word_ratio": sum(len(re.findall("[A-Za-z]", x)) >= 2 and not re.search("[a-z]", x) for x in w) / n, "capitalized_word_ratio": sum("A" <= x[0] <= "Z" for x in w[1:]) / max(1, len(w) - 1),
        "elongation_ratio": sum(bool(re.search(r"([a-z])\1\1", x)) for x in lw) / n, "contraction_ratio": sum(0 < x.find("'") < len(x) - 1 for x in w) / n,
        "ends_with_terminal": float(bool(re.search(r"[.!?…][\"'”’)\] \t\n\f\r]*\Z", t))), "starts_with_dialogue": float(t[:1] != "" and t[:1] in "\"“‘'-–—«"),
        "spacing_anomaly_rate": (sum(len(x) - 1 for x in re.findall(" {2,}", t)) + len(re.findall(" [,.;:!?]", t)) + len(re.findall(r"[,;!?][^\W\d_]", t))) / per_char,
    }


@pytest.mark.parametrize("size", [flat.SLICE, 50])
def test_arrays_measure_as_rules_do(monkeypatch, size):
    rows = texts()
    monkeypatch.setattr(flat.slices, "__defaults__", (size,))
    found = scalars.values(pa.array(["cut off", *rows, "behind"]).slice(1, len(rows)), [*scalars.GROUPS, "frequency", "counts"], pa.array(["a", "e"]))
    assert all(len(v) == len(rows) and np.isfinite(v).all() for v in found.values())
    for k, t in enumerate(rows):
        for name, value in by_rule(t).items():
            assert found[name][k] == pytest.approx(value), (name, t)


def test_syllables_over_arrays_as_by_expression(spark):
    from pyspark.sql import functions as F

    from quillmark.functions import text as X

    words = ["the", "table", "yellow", "walked", "wanted", "agree", "rhythm", "don't", "le", "ae", "ye", "''", "y", "needed", "e", "'ed", "abide", "12", "aged'"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", X.syllables(F.col("w")).alias("n")).collect()
    assert scalars.syllables(pa.array([r.w for r in rows])).tolist() == [r.n for r in rows]


def test_sentences_of_an_array():
    row, place, found = flat.sentences(pa.array(["a\r\n\r\n b\t\rc\n\n", None, "", "\n \x01", "é x y"]))
    assert (row.tolist(), place.tolist(), found.to_pylist()) == ([0, 0, 0, 4], [0, 1, 2, 0], ["a", "b", "c", "é x y"])
    assert [len(x) for x in flat.sentences(pa.array([], pa.string()))] == [0, 0, 0]


@pytest.mark.parametrize("query", ["pairs_absolute", "pair_overall_distance", "zscores", "scalars_readability", "lowered_orthography", "style_steps"])
def test_no_expression_for_each_word(spark, sf_dir, query):
    text = plan(query, spark, sf_dir)
    assert "MapInArrow" in text and "lambda" not in text


def test_embedding_input_joins_nothing(spark, sf_dir):
    assert "Join" not in plan("embedding_input", spark, sf_dir)


def test_document_numbers_over_arrays_as_one_by_one(monkeypatch):
    from quillmark.operators import documents

    lines = texts()
    rng = random.Random(5)
    docs = ["", None, "one", "É’tis ½ abc ſ İstanbul\nISTANBUL iİI ²³ a_b ΟΔΟΣ\n\n!!\n²x", *("\n".join(rng.choices(lines, k=rng.randrange(1, 200))) for _ in range(20))]
    each = [flat.sentences(pa.array([d], pa.string()))[2].to_pylist() for d in docs]
    style = np.array([documents.style_vector(s) for d in each for s in d])
    wanted = np.array([documents.document_numbers(d, style.mean(0), style.std(0)) for d in each])
    batch = documents.Batch(pa.array(docs))
    assert np.allclose(batch.styles(), style) and np.allclose(batch.numbers(style.mean(0), style.std(0)), wanted)
    monkeypatch.setattr(documents, "style_vector", None)  # neither is used for whole tables
    assert documents.Batch(pa.array(docs[:3])).numbers(style.mean(0), style.std(0)).shape == (3, 16)
    assert documents.topic_buckets(pa.array(["abc", "é😀x", "ünïted"])).tolist() == [documents.topic_bucket(w) for w in ("abc", "é😀x", "ünïted")]


def test_frequent_words_are_counted_in_the_batches(spark, sf_dir):
    from quillmark.functions.lexicon import frequent_words

    docs = spark.createDataFrame([(1, "B b a\nThe the"), (2, "a the b-B"), (3, None)], "doc_id long, text string")
    counted = scalars.word_counts(docs)
    assert frequent_words(counted, 2) == ["the", "a"] and "lambda" not in plan("scalars_frequent", spark, sf_dir)


def test_pair_matrix_is_made_once(spark, sf_dir):
    from quillmark.plans.model_queries import pair_matrix

    matrix, _ = pair_matrix(spark, sf_dir)
    assert matrix.storageLevel.useDisk and "InMemoryTableScan" in matrix.select("label")._jdf.queryExecution().executedPlan().toString()
