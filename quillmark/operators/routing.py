"""Routing: the level of a document decides its threshold; and turning scores into decisions, segments and files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ("easy", "medium", "hard")
MODES = ("auto", "auto-dataset", "none", *LEVELS)


def decided(probabilities: Column) -> Column:
    """The level of the greatest probability, the first of equal ones."""
    return F.get(F.array(*map(F.lit, LEVELS)), (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def dataset_vote(documents: DataFrame, probabilities: str = "probabilities") -> DataFrame:
    """One level for all documents: the greatest mean probability."""
    means = documents.agg(*[F.avg(F.get(F.col(probabilities), F.lit(k))).alias(f"m{k}") for k in range(len(LEVELS))])
    return means.select(decided(F.array(*[f"m{k}" for k in range(len(LEVELS))])).alias("level"))


def thresholds(documents: DataFrame, by_level: dict[str, float], pooled: float, mode: str | float = "auto") -> DataFrame:
    """``documents(doc_id, probabilities)`` with ``threshold``: by detected level, by the vote, by a named level, pooled, or as given."""
    if isinstance(mode, float):
        return documents.withColumn("threshold", F.lit(mode))
    if mode not in MODES:
        raise ValueError(f"mode must be a number or one of {MODES}")
    if mode == "none" or not by_level:
        return documents.withColumn("threshold", F.lit(pooled))
    table = documents.sparkSession.createDataFrame(list(by_level.items()), "level string, threshold double")
    if mode == "auto":
        named = documents.withColumn("level", decided(F.col("probabilities")))
    elif mode == "auto-dataset":
        named = documents.crossJoin(F.broadcast(dataset_vote(documents)))
    else:
        named = documents.withColumn("level", F.lit(mode))
    return named.join(F.broadcast(table), "level", "left").withColumn("threshold", F.coalesce("threshold", F.lit(pooled)))


def decisions(scored: DataFrame, documents: DataFrame) -> DataFrame:
    """``scored(doc_id, sent_idx, score)`` with decision: 1 where the score is over the document's threshold."""
    return scored.join(documents.select("doc_id", "threshold"), "doc_id").withColumn("decision", (F.col("score") > F.col("threshold")).cast("int"))


def outcomes(decided_: DataFrame) -> DataFrame:
    """TP, FP, FN or TN of each pair."""
    true = F.col("label") == 1
    said = F.col("decision") == 1
    return decided_.withColumn("outcome", F.when(said & true, "TP").when(said, "FP").when(true, "FN").otherwise("TN"))


def solutions(documents: DataFrame, decided_: DataFrame) -> DataFrame:
    """``(doc_id, solution)``: JSON with the changes of every document in order, an empty list for those without pairs."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "decision"))), lambda x: x.decision)
    lists = decided_.groupBy("doc_id").agg(ordered.alias("changes"))
    all_ = documents.select("doc_id").join(lists, "doc_id", "left").withColumn("changes", F.coalesce("changes", F.array().cast("array<int>")))
    return all_.select("doc_id", F.to_json(F.struct("changes")).alias("solution"))


def constant_output(decided_: DataFrame, least: int = 50) -> DataFrame:
    """Documents with over ``least`` pairs whose decisions are all equal: a sign that a model doesn't fit its input."""
    per = decided_.groupBy("doc_id").agg(F.count("*").alias("pairs"), F.min("decision").alias("lo"), F.max("decision").alias("hi"))
    return per.where((F.col("pairs") > least) & (F.col("lo") == F.col("hi"))).select("doc_id", "pairs", F.col("lo").alias("decision"))
