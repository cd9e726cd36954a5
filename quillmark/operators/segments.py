"""Segments of documents, boundary scores, and what is known about authors of segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def segment_ids(sentences: DataFrame, change: str = "change") -> DataFrame:
    """``sentences`` with segment: how many changes came up to the sentence. The first sentence's change is nothing."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    return sentences.withColumn("segment", F.sum(F.coalesce(F.col(change), F.lit(0))).over(order).cast("int"))


def segments(sentences: DataFrame) -> DataFrame:
    """``(doc_id, segment, first, end, sentences)`` with end behind the last sentence."""
    return sentences.groupBy("doc_id", "segment").agg(F.min("sent_idx").alias("first"), (F.max("sent_idx") + 1).alias("end"), F.count("*").alias("sentences"))


def offsets(per_segment: DataFrame) -> DataFrame:
    """``per_segment`` with the document's number of segments, and each segment's place and first sentence among all of its
    document's sentences."""
    order = Window.partitionBy("doc_id").orderBy("segment")
    return per_segment.withColumn("segments", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("start", F.sum("sentences").over(order) - F.col("sentences"))


def author_relation(i: Column, j: Column, n_segments: Column, authors: Column) -> Column:
    """same, different or unknown for segments i < j: neighbours differ; as many authors as segments: all differ; two authors take turns."""
    return (
        F.when(i == j, "same").when(j - i == 1, "different").when(authors == n_segments, "different").when(authors == 2, F.when((j - i) % 2 == 0, "same").otherwise("different")).otherwise("unknown")
    )


def relations(per_segment: DataFrame, authors: DataFrame) -> DataFrame:
    """The relation of all pairs of segments of a document."""
    counts = per_segment.groupBy("doc_id").agg(F.count("*").alias("n_segments")).join(authors, "doc_id")
    a = per_segment.select("doc_id", F.col("segment").alias("i")).join(counts, "doc_id")
    b = per_segment.select("doc_id", F.col("segment").alias("j"))
    return a.join(b, "doc_id").where("i < j").select("doc_id", "i", "j", author_relation(F.col("i"), F.col("j"), F.col("n_segments"), F.col("authors")).alias("relation"))


def boundary_scores(vectors: DataFrame, columns: list[str], window: int) -> DataFrame:
    """(1 - cosine) / 2 between the sums of up to ``window`` vectors on each side of a boundary, cut at the document's ends."""
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    left, right = order.rowsBetween(-(window - 1), 0), order.rowsBetween(1, window)
    s = vectors.select("doc_id", "sent_idx", *[F.sum(c).over(left).alias(f"l_{c}") for c in columns], *[F.sum(c).over(right).alias(f"r_{c}") for c in columns], F.lead("sent_idx").over(order).alias("__next"))
    add = lambda f: sum((f(F.col(f"l_{c}"), F.col(f"r_{c}")) for c in columns), F.lit(0.0))
    cosine = add(lambda x, y: x * y) / (F.sqrt(add(lambda x, y: x * x) * add(lambda x, y: y * y)) + 1e-12)
    return s.where("__next IS NOT NULL").select("doc_id", "sent_idx", ((1 - cosine) / 2).alias("score"))
