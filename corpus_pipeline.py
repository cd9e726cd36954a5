"""From raw documents to packed training sequences: quality, repeated lines, near copies, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import lines, near_dedup, packing, quality
from quillmark.llm.common import scratch
from quillmark.llm.queries import mixed

LEAST_QUALITY = 0.7
MOST_SENT = 1_000_000


def _with_own_columns(docs: DataFrame, run: Callable[[DataFrame], DataFrame], *made: str) -> DataFrame:
    """What ``run`` leaves of ``docs``, with the columns of ``docs``; those named as columns that it makes are set aside meanwhile."""
    aside = {c: f"__own_{k}" for k, c in enumerate(docs.columns) if c.lower() in made}
    return run(docs.withColumnsRenamed(aside)).select(*[F.col(f"`{aside.get(c, c)}`").alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking, learned from the labelled ones among them, doesn't reject.

    Null and empty texts are scored as texts without words; repeated rows fare alike; without labels of both kinds every
    score is the labels' share, so all or none stay. All columns come back as they were; an empty table stays empty.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model, LEAST_QUALITY)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines they share with many others; ``n_chars`` follows the text.

    A null text becomes empty; no row goes; rows of one doc_id are one holder of their lines, and so are rows without
    one. All other columns come back as they were, whatever their names; an empty table stays empty.
    """
    cleaned = _with_own_columns(docs, lines.drop_shared_lines, "n_lines", "n_dropped")
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cleaned


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id.

    Documents without words and rows without a doc_id stay. Rows that repeat a doc_id and its text are one document, of
    which one row stays (any of them, if other columns differ). An empty table stays empty.
    """
    base = scratch(spark, "near")
    near_dedup.link_documents(docs).groupBy("doc_id").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("doc_id IS NOT NULL AND (NOT kept OR n > 1)").write.parquet(base)
    marked = spark.read.parquet(base)

    def sent(ids: DataFrame) -> DataFrame:
        return F.broadcast(ids) if ids.count() <= MOST_SENT else ids

    left = docs.join(sent(marked.where("NOT kept").select("doc_id")), "doc_id", "left_anti")
    repeated = sent(marked.where("kept AND n > 1").select("doc_id"))
    once = left.join(repeated, "doc_id", "left_anti").unionByName(left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return once.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target weights of sources, languages and topics.

    A column ``topic`` is the table's own topic, if there is one. Null names are a category; documents without words are
    drawn like others of their cell; repeated rows are drawn alike. All columns come back as they were, whatever their
    names; an empty table stays empty.
    """
    made = ("n_tokens", "probability", "kept") if "topic" in docs.columns else ("n_tokens", "probability", "kept", "topic")
    return _with_own_columns(docs, lambda d: mixed(d).where("kept"), *made)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, with the ids.

    A null or empty text is an end id; every row is packed, repeated ones too; other columns are left behind; an empty
    table gives no pieces.
    """
    return packing.pack(docs)


STAGES = [("quality classifier", keep_quality), ("line dedup", drop_lines), ("near-dedup", keep_one_of_each), ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = scratch(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
