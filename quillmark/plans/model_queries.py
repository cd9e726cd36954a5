"""Queries on tags, document numbers and models. They have no SQL: rules over tokens, hashes of strings, and training."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.functions import scalars, tagger
from quillmark.functions import text as X
from quillmark.operators import documents, metrics, models, pairs, profiles, routing, segments
from quillmark.plans.base import PREP, query, rounded
from quillmark.sources.readers import labelled_conversations, sentences, table

GROUPS = ["length", "marks", "orthography", "word_length"]


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.prepared(sentences(table(spark, sf_dir, "documents"))).select("doc_id", "sent_idx", X.linguistic_tokens(F.col("t")).alias("parts"))
    return s.select("doc_id", "sent_idx", tagger.tags(F.col("parts")).alias("tags"))


@query()
def scalars_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tagged(spark, sf_dir).select("doc_id", "sent_idx", *[c.cast("double").alias(k) for k, c in tagger.tag_shares(F.col("tags")).items()]))


@query()
def profile_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiled = profiles.tag_profile(_tagged(spark, sf_dir), 2, 16).select("doc_id", "sent_idx", F.posexplode("profile").alias("bucket", "share"))
    return rounded(profiled.where("share > 0"))


@query(
    rf"""WITH {PREP}, tk AS (SELECT doc_id, sent_idx, regexp_extract_all(t, '\p{{L}}[\p{{L}}\p{{N}}]*(?:[''’]\p{{L}}+)*(?:-\p{{L}}[\p{{L}}\p{{N}}]*)*|\p{{N}}+(?:[.,]\p{{N}}+)*|\.{{2,}}|…|[^ \t\n\x0B\f\r]') AS parts FROM prep)
SELECT doc_id, sent_idx, CAST(len(parts) AS INT) AS tokens, CAST(len(list_filter(parts, lambda x: NOT regexp_matches(x, '[\p{{L}}\p{{N}}]'))) AS INT) AS marks, parts[1] AS first FROM tk"""
)
def linguistic_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scalars.prepared(sentences(table(spark, sf_dir, "documents"))).select("doc_id", "sent_idx", X.linguistic_tokens(F.col("t")).alias("parts"))
    marks = F.size(F.filter("parts", lambda x: ~x.rlike(r"[\p{L}\p{N}]")))
    return s.select("doc_id", "sent_idx", F.size("parts").alias("tokens"), marks.alias("marks"), F.get("parts", F.lit(0)).alias("first"))


@query()
def document_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(documents.numbers(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query(f"""WITH {PREP}, s AS (SELECT doc_id, ln(1 + len(tokens)) AS x FROM prep), g AS (SELECT doc_id, count(*) AS n, avg(x) AS m, stddev_pop(x) AS d FROM s GROUP BY doc_id)
SELECT doc_id, round(ln(1 + coalesce(n, 0)), 6) AS log_sentences, round(CASE WHEN n >= 2 THEN m ELSE 0 END, 6) AS mean_log_words, round(CASE WHEN n >= 2 THEN d ELSE 0 END, 6) AS std_log_words FROM documents LEFT JOIN g USING (doc_id)""")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three numbers of length, of every document, in the JVM."""
    docs = table(spark, sf_dir, "documents")
    per = scalars.prepared(sentences(docs)).groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.log1p("n_words")).alias("m"), F.stddev_pop(F.log1p("n_words")).alias("d"))
    enough = lambda c: F.when(F.col("n") >= 2, F.col(c)).otherwise(0.0)
    out = docs.select("doc_id").join(per, "doc_id", "left")
    return rounded(out.select("doc_id", F.log1p(F.coalesce("n", F.lit(0))).alias("log_sentences"), enough("m").alias("mean_log_words"), enough("d").alias("std_log_words")))


def pair_matrix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """Neighbouring lines of conversations as absolute differences of z-scores, with ``label``: whether the speaker changes.

    The matrix is persisted, since a fit and the scores read it several times and lines are measured in Arrow batches.
    """
    s = labelled_conversations(table(spark, sf_dir, "conversations"))
    v = scalars.measured(s, GROUPS, keep=("doc_id", "sent_idx", "change"))
    columns = [c for c in v.columns if c not in ("doc_id", "sent_idx", "change")]
    fitted = pairs.fit_scaler(v, columns)
    z = v.select("doc_id", "sent_idx", F.lead("change").over(Window.partitionBy("doc_id").orderBy("sent_idx")).alias("label"), *[pairs.zscore(c, fitted[c]).alias(c) for c in columns])
    near = pairs.neighbours(z, columns, keep=("label",))
    return near.select("doc_id", "sent_idx", "label", *[F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias(c) for c in columns]).persist(), columns


def _scores(scored: DataFrame) -> DataFrame:
    return rounded(scored.select("doc_id", "sent_idx", "label", "score"))


@query()
def logistic_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, columns = pair_matrix(spark, sf_dir)
    return _scores(models.score(matrix, models.fit_logistic(matrix, columns), columns))


@query()
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, columns = pair_matrix(spark, sf_dir)
    return _scores(models.score(matrix, models.fit_tree(matrix, columns, depth=5), columns))


def sampled(matrix: DataFrame, columns: list[str], most: int = 150_000) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` rows, the first in hash order, for the networks, which train in one task."""
    rows = matrix.orderBy(F.xxhash64("doc_id", "sent_idx"), "doc_id", "sent_idx").limit(most).select("label", *columns).toArrow()
    return np.column_stack([rows.column(c).to_numpy() for c in columns]), rows.column("label").to_numpy().astype(float)


@query()
def mlp_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix, columns = pair_matrix(spark, sf_dir)
    net = models.fit_network(*sampled(matrix, columns), hidden=(32, 16), epochs=20)
    return _scores(models.apply_network(matrix, net, columns))


@query()
def softmax_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language from its sixteen numbers and their squares, as the level detector does it."""
    docs = table(spark, sf_dir, "documents")
    n = documents.numbers(docs.select("doc_id", "text")).persist()  # 17 numbers a document, read by the scaler, the fit and the scores
    fitted = pairs.fit_scaler(n, list(documents.NAMES))
    z = n.select("doc_id", *[pairs.zscore(c, fitted[c]).alias(c) for c in documents.NAMES])
    z = z.select("doc_id", *documents.NAMES, *[(F.col(c) * F.col(c)).alias(f"{c}_2") for c in documents.NAMES])
    kinds = F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")])
    rows = z.join(docs.select("doc_id", (F.array_position(kinds, F.col("lang")) - 1).cast("int").alias("label")), "doc_id")
    columns = [c for c in z.columns if c != "doc_id"]
    scored = models.score(rows, models.fit_softmax(rows, columns, iterations=50), columns, "probabilities")
    return scored.select("doc_id", "label", (F.array_position("probabilities", F.array_max("probabilities")) - 1).cast("int").alias("predicted"))


@query()
def embedding_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boundary scores between sentences embedded by a network that learned from triplets of speakers' segments."""
    s = segments.segment_ids(labelled_conversations(table(spark, sf_dir, "conversations")))
    v = scalars.measured(s, GROUPS, keep=("doc_id", "sent_idx", "segment", "change"))
    columns = [c for c in v.columns if c not in ("doc_id", "sent_idx", "segment", "change")]
    fitted = pairs.fit_scaler(v, columns)
    z = v.select("doc_id", "sent_idx", "segment", "change", *[pairs.zscore(c, fitted[c]).alias(c) for c in columns])
    part = min(1.0, 150_000 / max(1, z.count()))  # whole documents, by hash
    own = z.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("doc_id", "sent_idx", "segment", *columns).toArrow().sort_by([("doc_id", "ascending"), ("sent_idx", "ascending")])
    x = np.column_stack([own.column(c).to_numpy() for c in columns])
    rows = [(d, g, k) for k, (d, g) in enumerate(zip(own.column("doc_id").to_pylist(), own.column("segment").to_pylist()))]
    held = models.draw_triplets([r for r in rows if r[0] % 5 == 0], 500)
    net = models.fit_embedding(x, models.draw_triplets([r for r in rows if r[0] % 5], 4000), hidden=(64,), dim=8, epochs=5, held=(x, held))
    e = models.apply_network(z, net, columns, "e", embed=True)
    flat = e.select("doc_id", "sent_idx", *[F.col("e")[k].alias(f"e{k}") for k in range(8)])
    return rounded(segments.boundary_scores(flat, [f"e{k}" for k in range(8)], 1))


@query()
def predicted_solutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores, the best threshold, decisions, and the JSON that each document gets."""
    matrix, columns = pair_matrix(spark, sf_dir)
    scored = models.score(matrix, models.fit_logistic(matrix, columns), columns)
    cut = metrics.best_threshold(scored).first().threshold
    docs = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    return routing.solutions(docs, routing.decisions(scored, routing.thresholds(docs, {}, cut, "none")))
