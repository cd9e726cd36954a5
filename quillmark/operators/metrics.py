"""Evaluation: confusion matrices, thresholds, AUC, author counts and ranked retrieval, each by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STEPS = 200


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def derived(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    n, p, q = tp + fp + fn + tn, tp + fn, tn + fp
    change, same = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    return {
        "accuracy": ratio(tp + tn, n), "precision": ratio(tp, tp + fp), "recall": ratio(tp, p), "specificity": ratio(tn, q), "balanced_accuracy": (ratio(tp, p) + ratio(tn, q)) / 2,
        "f1_change": change, "f1_same": same, "macro_f1": (change + same) / 2, "majority": ratio(F.greatest(p, q), n),
    }


COUNTS = ("tp", "fp", "fn", "tn")


def confusion(scored: DataFrame, *groups: str, threshold: float | Column = 0.5) -> DataFrame:
    """Counts and measures of score > threshold (strictly) against label, by group."""
    said = F.col("score") > (F.lit(threshold) if isinstance(threshold, float) else threshold)
    true = F.col("label") == 1
    counts = {"tp": said & true, "fp": said & ~true, "fn": ~said & true, "tn": ~said & ~true}
    table = scored.groupBy(*groups).agg(*[F.count_if(c).alias(k) for k, c in counts.items()])
    return table.select(*groups, *COUNTS, *[c.alias(k) for k, c in derived(*map(F.col, COUNTS)).items()])


def sweep(scored: DataFrame, *groups: str) -> DataFrame:
    """The confusion at each of the 199 cuts k / 200, in one pass: rows are counted by the highest cut below them, and the
    counts (at most 200 a group) are summed from the top."""
    k = F.floor(F.col("score") * STEPS)
    k = F.when(F.col("score") > k / F.lit(float(STEPS)), k).otherwise(k - 1)
    counted = scored.select(*groups, F.least(F.greatest(k, F.lit(0)), F.lit(STEPS - 1)).cast("int").alias("step"), "label")
    counted = counted.groupBy(*groups, "step").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    steps = scored.sparkSession.range(0, STEPS).select(F.col("id").cast("int").alias("step"))
    grid = counted.select(*groups).distinct().join(F.broadcast(steps)) if groups else steps
    filled = grid.join(counted, [*groups, "step"], "left").na.fill(0, ["p", "q"])
    above = Window.partitionBy(*groups).orderBy(F.desc("step"))
    whole = Window.partitionBy(*groups)
    summed = filled.select(*groups, "step", F.sum("p").over(above).alias("tp"), F.sum("q").over(above).alias("fp"), F.sum("p").over(whole).alias("np"), F.sum("q").over(whole).alias("nq"))
    summed = summed.where("step > 0").select(*groups, "step", "tp", "fp", (F.col("np") - F.col("tp")).alias("fn"), (F.col("nq") - F.col("fp")).alias("tn"))
    return summed.select(*groups, "step", *COUNTS, derived(*map(F.col, COUNTS))["macro_f1"].alias("macro_f1"))


def best_threshold(scored: DataFrame, *groups: str) -> DataFrame:
    """The middle of the first plateau of the best macro-F1 among the cuts; a plateau ends where the value falls."""
    steps = sweep(scored, *groups)
    best = steps.groupBy(*groups).agg(F.max("macro_f1").alias("best"))
    marked = steps.join(best, list(groups)) if groups else steps.crossJoin(best)
    marked = marked.withColumn("top", F.col("macro_f1") >= F.col("best") - 1e-12)
    first = marked.groupBy(*groups).agg(F.max("best").alias("best"), F.min(F.when(F.col("top"), F.col("step"))).alias("first"))
    after = (marked.drop("best").join(first, list(groups)) if groups else marked.drop("best").crossJoin(first)).where("step > first AND NOT top")
    end = after.groupBy(*groups).agg((F.min("step") - 1).alias("last"))
    joined = first.join(end, list(groups), "left") if groups else first.crossJoin(end)
    return joined.select(*groups, ((F.col("first") + F.coalesce("last", F.lit(STEPS - 1))) / (2.0 * STEPS)).alias("threshold"), "best")


def auc(scored: DataFrame, *groups: str, bins: int = 1024) -> DataFrame:
    """Area under the ROC curve with average ranks for ties; 0.5 where a class is missing. Scores lie from 0 to 1.

    Scores are ordered within ``bins`` ranges, and only the ranges' sums are ordered over a whole group, so no task sorts one.
    """
    per = scored.groupBy(*groups, "score").agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("q"))
    per = per.withColumn("bin", F.floor(F.col("score") * bins))
    ranges = per.groupBy(*groups, "bin").agg(F.sum("q").alias("s"))
    ranges = ranges.withColumn("below", F.sum("s").over(Window.partitionBy(*groups).orderBy("bin")) - F.col("s")).drop("s")
    own = F.sum("q").over(Window.partitionBy(*groups, "bin").orderBy("score")) - F.col("q")
    ranked = per.withColumn("inside", own).join(ranges, [*groups, "bin"])
    sums = ranked.groupBy(*groups).agg(F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return sums.select(*groups, F.when((F.col("np") == 0) | (F.col("nq") == 0), 0.5).otherwise(F.col("u") / F.greatest(F.col("np") * F.col("nq"), F.lit(1))).alias("auc"))


def nearest_rank(values: Column, fraction: float) -> Column:
    """The value at index floor(f (n - 1) + 0.5) of the sorted array."""
    return F.get(F.sort_array(values), F.floor(F.lit(fraction) * (F.size(values) - 1) + 0.5).cast("int"))


def author_counts(documents: DataFrame, *groups: str) -> DataFrame:
    """Of ``(estimated, authors)``: documents with a known count, share of exact ones, mean absolute and mean signed error."""
    known = documents.where(F.col("authors") >= 1).withColumn("e", F.col("estimated") - F.col("authors"))
    return known.groupBy(*groups).agg(F.count("*").alias("documents"), F.avg((F.col("e") == 0).cast("double")).alias("exact"), F.avg(F.abs("e")).alias("mae"), F.avg("e").alias("signed"))


def similarities(vectors: DataFrame, group: str = "doc_id", key: str = "idx", vector: str = "x") -> DataFrame:
    """Cosine of all ordered pairs within a document (an equi-join on it): ``(doc_id, query, other, similarity)``."""
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    unit = vectors.select(group, F.col(key), F.col("segment"), F.col(vector).cast("array<double>").alias("x")).withColumn("norm", norm(F.col("x")))
    a = unit.toDF(group, "query", "query_segment", "x", "nx")
    b = unit.toDF(group, "other", "other_segment", "y", "ny")
    dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return a.join(b, group).where("query <> other").select(group, "query", "other", "query_segment", "other_segment", (dot / (F.col("nx") * F.col("ny") + 1e-12)).alias("similarity"))


def ranked(pairs: DataFrame, group: str = "doc_id") -> DataFrame:
    """The other sentences of each query in order of similarity, ties by place."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy(group, "query").orderBy(F.desc("similarity"), "other")))


def retrieval(pairs: DataFrame, *groups: str, group: str = "doc_id") -> DataFrame:
    """P@1, recall@5, MRR and MAP; others of the query's segment are relevant, and queries without any don't count."""
    hit = (F.col("query_segment") == F.col("other_segment")).cast("int")
    r = ranked(pairs, group).withColumn("hit", hit)
    r = r.withColumn("hits", F.sum("hit").over(Window.partitionBy(group, "query").orderBy("rank")))
    per = r.groupBy(*{group, *groups}, "query").agg(
        F.sum("hit").alias("n"), F.sum(F.when(F.col("rank") == 1, F.col("hit")).otherwise(0)).alias("p1"), F.sum(F.when(F.col("rank") <= 5, F.col("hit")).otherwise(0)).alias("r5"),
        F.min(F.when(F.col("hit") == 1, F.col("rank"))).alias("first"), F.sum(F.when(F.col("hit") == 1, F.col("hits") / F.col("rank")).otherwise(0.0)).alias("ap"),
    ).where("n > 0")
    return per.groupBy(*groups).agg(F.count("*").alias("queries"), F.avg("p1").alias("p_at_1"), F.avg(F.col("r5") / F.col("n")).alias("recall_at_5"), F.avg(1 / F.col("first")).alias("mrr"), F.avg(F.col("ap") / F.col("n")).alias("map"))


def triplet_accuracy(pairs: DataFrame, group: str = "doc_id") -> DataFrame:
    """Share of (query, adjacent segment) where the mean similarity to the query's own segment is greater, strictly."""
    means = pairs.groupBy(group, "query", "query_segment", "other_segment").agg(F.avg("similarity").alias("mean"))
    mates = means.where("query_segment = other_segment").select(group, "query", F.col("mean").alias("own"))
    beside = means.where("abs(query_segment - other_segment) = 1").join(mates, [group, "query"])
    return beside.agg(F.count("*").alias("triplets"), F.avg((F.col("own") > F.col("mean")).cast("double")).alias("triplet_accuracy"))
