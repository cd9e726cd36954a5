"""The level detector: how hard a document's boundaries are, from its sixteen numbers; and which threshold that routes it to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators import documents, metrics, models, pairs, routing

NAMES = documents.NAMES


@dataclass(frozen=True)
class Detector:
    scaler: dict[str, tuple[float, float]]
    style: tuple
    model: object
    levels: tuple[str, ...]

    def inputs(self, numbers: DataFrame, *keep: str) -> DataFrame:
        z = numbers.select("doc_id", *keep, *[pairs.zscore(c, self.scaler[c]).alias(c) for c in NAMES])
        return z.select("*", *[(F.col(c) * F.col(c)).alias(f"{c}_2") for c in NAMES])

    def probabilities(self, docs: DataFrame) -> DataFrame:
        """``(doc_id, probabilities)`` of ``docs(doc_id, text)``, in the order of the levels."""
        rows = self.inputs(documents.numbers(docs.select("doc_id", "text"), self.style))
        return models.score(rows, self.model, inputs(), "probabilities").select("doc_id", "probabilities")


def inputs() -> list[str]:
    return [*NAMES, *(f"{c}_2" for c in NAMES)]


def fit(docs: DataFrame, levels: tuple[str, ...] = routing.LEVELS, most: int = 20_000, iterations: int = 200) -> Detector:
    """A softmax over the z-scores of the sixteen numbers and their squares, of about ``most`` documents of each level at
    most, chosen by hash. ``docs(doc_id, text, level)``; documents of other levels are left out."""
    known = docs.where(F.col("level").isin(*levels))
    counts = known.groupBy("level").agg(F.least(F.lit(1.0), F.lit(float(most)) / F.count("*")).alias("__part"))
    own = known.join(F.broadcast(counts), "level").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.col("__part") * (1 << 20))
    style = documents.style_scale(own.select("doc_id", "text"))
    numbers = documents.numbers(own.select("doc_id", "text"), style).join(own.select("doc_id", "level"), "doc_id").persist()
    detector = Detector(pairs.fit_scaler(numbers, list(NAMES)), style, None, levels)
    place = F.array_position(F.array(*map(F.lit, levels)), F.col("level"))
    rows = detector.inputs(numbers, "level").withColumn("label", (place - 1).cast("int"))
    model = models.fit_softmax(rows, inputs(), iterations=iterations)
    numbers.unpersist()
    return Detector(detector.scaler, style, model, levels)


def mean_numbers(docs: DataFrame) -> DataFrame:
    """The mean of each of the sixteen numbers by level."""
    numbers = documents.numbers(docs.select("doc_id", "text")).join(docs.select("doc_id", "level"), "doc_id")
    return numbers.groupBy("level").agg(F.count("*").alias("documents"), *[F.avg(c).alias(c) for c in NAMES])


def confusion(detected: DataFrame, levels: tuple[str, ...] = routing.LEVELS) -> DataFrame:
    """Documents of each true level by detected one, from ``(level, probabilities)``."""
    said = detected.withColumn("said", routing.decided(F.col("probabilities")))
    return said.groupBy("level").pivot("said", list(levels)).agg(F.count("said")).na.fill(0)


def schemes(scored: DataFrame, docs: DataFrame, by_level: dict[str, float], pooled: float) -> DataFrame:
    """Macro-F1 of ``scored(doc_id, score, label)`` by level and over all, under four thresholds: pooled, of the true level, of
    the detected one, and of the level that all documents vote for. ``docs(doc_id, level, probabilities)``."""
    table = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in by_level.items()], "known string, cut double")
    vote = docs.agg(*[F.avg(F.get("probabilities", F.lit(k))).alias(f"m{k}") for k in range(len(routing.LEVELS))]).select(routing.decided(F.array(*[f"m{k}" for k in range(len(routing.LEVELS))])).alias("vote"))
    named = docs.withColumn("detected", routing.decided(F.col("probabilities"))).crossJoin(F.broadcast(vote))  # one row
    cuts = named.select("doc_id", "level", F.explode(F.array(*[F.struct(F.lit(s).alias("scheme"), F.col(c).alias("known")) for s, c in (("true", "level"), ("detected", "detected"), ("vote", "vote"))])).alias("x")).select("doc_id", "level", "x.*")
    cuts = cuts.unionByName(docs.select("doc_id", "level", F.lit("pooled").alias("scheme"), F.lit(None).cast("string").alias("known")))
    cuts = cuts.join(F.broadcast(table), "known", "left").select("doc_id", "level", "scheme", F.coalesce("cut", F.lit(pooled)).alias("cut"))
    rows = scored.select("doc_id", "score", "label").join(cuts, "doc_id").withColumn("said", F.col("score") > F.col("cut")).withColumn("true", F.col("label") == 1)
    counts = {"tp": F.col("said") & F.col("true"), "fp": F.col("said") & ~F.col("true"), "fn": ~F.col("said") & F.col("true"), "tn": ~F.col("said") & ~F.col("true")}
    out = rows.rollup("scheme", "level").agg(*[F.count_if(c).alias(k) for k, c in counts.items()]).where("scheme IS NOT NULL")
    return out.select("scheme", F.coalesce("level", F.lit("all")).alias("level"), *metrics.COUNTS, metrics.derived(*map(F.col, metrics.COUNTS))["macro_f1"].alias("macro_f1"))


def routed_models(found: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """Of models with their thresholds by level those that have one for every level."""
    return {k: v for k, v in found.items() if set(routing.LEVELS) <= set(v)}
