"""Emotion scores of sentences: tokens meet a word-emotion table in a join, broadcast when the table is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import lookup_key

MOST_SENT = 100_000


def emotion_score(prepared: DataFrame, lexicon: DataFrame, emotions: tuple[str, ...]) -> DataFrame:
    """``(doc_id, sent_idx, emotion_score)``: the mean of the emotions' positive totals over a sentence's tokens, per token.

    ``lexicon`` has a row for each word with a column for each emotion. A table of up to 100,000 words is sent to the
    executors, a larger one is joined by a shuffle.
    """
    tokens = prepared.select("doc_id", "sent_idx", F.explode(F.transform("tokens", lookup_key)).alias("word"))
    small = lexicon.limit(MOST_SENT + 1).count() <= MOST_SENT
    hits = tokens.join(F.broadcast(lexicon) if small else lexicon, "word")
    totals = hits.groupBy("doc_id", "sent_idx").agg(*[F.sum(e).alias(e) for e in emotions])
    positive = F.filter(F.array(*emotions), lambda x: x > 0)
    mean = F.when(F.size(positive) > 0, F.aggregate(positive, F.lit(0).cast("double"), lambda a, x: a + x.cast("double")) / F.size(positive)).otherwise(0.0)
    scored = totals.select("doc_id", "sent_idx", mean.alias("m"))
    per_token = F.greatest(F.size("tokens"), F.lit(1))
    return prepared.select("doc_id", "sent_idx", per_token.alias("n")).join(scored, ["doc_id", "sent_idx"], "left").select("doc_id", "sent_idx", (F.coalesce("m", F.lit(0.0)) / F.col("n")).alias("emotion_score"))
