"""What a user asks of one or many texts: predictions, an analysis, what a model reads, and the sentences nearest to each other.

Every function takes ``sentences(doc_id, sent_idx, sentence)`` of any number of documents and answers for all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmark.operators import features, levels, metrics, models, retrieval, routing, segments

MOST_RETRIEVED, MOST_NEAR = 60, 10  # sentences of a document that are compared, and neighbours shown


def shown(value: Column, digits: int = 3) -> Column:
    """Rounded for display, halves up."""
    return F.floor(value * 10**digits + 0.5) / 10**digits


def position(sent_idx: Column, n: Column) -> Column:
    """A sentence's place in its document from 0 to 1; 0 in a document of one."""
    return F.when(n > 1, sent_idx / F.greatest(n - 1, F.lit(1))).otherwise(0.0)


def valid_truth(changes: Column, n: Column) -> Column:
    """Whether changes are 0 or 1 and there is one less than sentences."""
    return F.coalesce((F.size(changes) == n - 1) & F.forall(changes, lambda c: F.coalesce(c.isin(0, 1), F.lit(False))), F.lit(False))


def with_positions(sentences: DataFrame) -> DataFrame:
    """``sentences`` with n, the document's sentences, and position."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return sentences.withColumn("n", n).withColumn("position", position(F.col("sent_idx"), F.col("n")))


@dataclass(frozen=True)
class Service:
    """A model of pairs with its extractor and pooled threshold; a level detector with thresholds by level, if there is one."""

    extractor: features.Extractor
    model: object
    threshold: float
    detector: levels.Detector | None = None
    by_level: dict[str, float] | None = None

    def pairs(self, sentences: DataFrame) -> DataFrame:
        return features.evaluation_matrix(sentences, self.extractor, None)

    def scores(self, sentences: DataFrame) -> DataFrame:
        """``(doc_id, sent_idx, score)``: the chance of a change behind each sentence but the last."""
        return models.change_scores(self.pairs(sentences), self.model, features.pair_names(self.extractor.config)).select("doc_id", "sent_idx", "score")

    def documents(self, sentences: DataFrame) -> DataFrame:
        """``(doc_id, probabilities)`` of levels; null without a detector."""
        text = sentences.groupBy("doc_id").agg(F.concat_ws("\n", F.transform(F.sort_array(F.collect_list(F.struct("sent_idx", "sentence"))), lambda x: x.sentence)).alias("text"))
        return self.detector.probabilities(text) if self.detector else text.select("doc_id", F.lit(None).cast("array<double>").alias("probabilities"))

    def reason(self, mode: str | float) -> str:
        """Why documents get the threshold they get."""
        if isinstance(mode, float):
            return "given threshold"
        if mode == "none":
            return "pooled threshold asked"
        if not self.by_level:
            return "pooled: no thresholds by level"
        return "pooled: no level detector" if mode.startswith("auto") and not self.detector else f"by level, {mode}"

    def predict(self, sentences: DataFrame, mode: str | float = "auto", truth: DataFrame | None = None) -> dict[str, DataFrame]:
        """Of each pair its score, threshold, decision and, with ``truth(doc_id, sent_idx, label)``, outcome; the segments; the
        solutions; and with truth the measures."""
        routed = routing.thresholds(self.documents(sentences), self.by_level or {}, self.threshold, mode if not self.reason(mode).startswith("pooled") else "none")
        out = routing.decisions(self.scores(sentences), routed)
        result = {"pairs": out, "documents": routed.withColumn("reason", F.lit(self.reason(mode)))}
        cuts = sentences.select("doc_id", "sent_idx").join(out.select("doc_id", (F.col("sent_idx") + 1).alias("sent_idx"), F.col("decision").alias("change")), ["doc_id", "sent_idx"], "left")
        result["segments"] = segments.segments(segments.segment_ids(cuts))
        result["solutions"] = routing.solutions(routed, out)
        if truth is not None:
            known = out.join(truth, ["doc_id", "sent_idx"])
            result["pairs"] = routing.outcomes(known)
            result["measures"] = metrics.confusion(known.select("label", F.col("decision").cast("double").alias("score")), threshold=0.5)
        return result

    def chance(self, spark: SparkSession, first: str, second: str) -> float:
        """The chance of a change between two sentences, as a document of the two."""
        return float(self.scores(spark.createDataFrame([(0, 0, first), (0, 1, second)], "doc_id long, sent_idx int, sentence string")).first().score)

    def pair_features(self, spark: SparkSession, first: str, second: str) -> dict[str, float]:
        """What the model reads of two sentences."""
        row = self.pairs(spark.createDataFrame([(0, 0, first), (0, 1, second)], "doc_id long, sent_idx int, sentence string")).first().asDict()
        return {k: v for k, v in row.items() if k not in features.KEYS}

    def explain(self, sentences: DataFrame) -> DataFrame:
        """Of each pair the conditions that it passes in the tree."""
        return models.explained(self.pairs(sentences), models.nodes(self.model, features.pair_names(self.extractor.config))).select("doc_id", "sent_idx", "path")

    def analyse(self, sentences: DataFrame, limit: int = 300) -> dict[str, DataFrame]:
        """The 63 scalars of each sentence (of the first ``limit`` of a document) with its position, their summary by document,
        level probabilities, and segments with their words."""
        sentences = sentences.select(*features.KEYS, "sentence")
        vectors = self.extractor.vectors(sentences)
        rows = with_positions(vectors.select("doc_id", "sent_idx", *features.SCALARS)).where(F.col("sent_idx") < limit)
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("scalar"), F.col(c).alias("v")) for c in features.SCALARS]))
        summary = vectors.select("doc_id", each.alias("x")).select("doc_id", "x.*").groupBy("doc_id", "scalar")
        words = sentences.withColumn("words", F.size(F.filter(F.split("sentence", r"\s+"), lambda w: w != "")))
        cut = self.predict(sentences)["pairs"].select("doc_id", (F.col("sent_idx") + 1).alias("sent_idx"), F.col("decision").alias("change"))
        placed = segments.segment_ids(words.join(cut, ["doc_id", "sent_idx"], "left"))
        return {
            "sentences": rows, "documents": self.documents(sentences),
            "summary": summary.agg(F.min("v").alias("least"), F.max("v").alias("most"), F.avg("v").alias("mean"), F.coalesce(F.stddev_pop("v"), F.lit(0.0)).alias("deviation")),
            "segments": placed.groupBy("doc_id", "segment").agg(F.min("sent_idx").alias("first"), (F.max("sent_idx") + 1).alias("end"), F.sum("words").alias("words")),
        }


def inspect(sentences: DataFrame, extractor: features.Extractor | None = None) -> dict[str, DataFrame]:
    """Raw and standardised scalars, buckets in use, and the pair with the next sentence; without an extractor one is fitted
    on the given sentences."""
    if extractor is None:
        extractor, vectors = features.fit(sentences.select("doc_id", "sent_idx", "sentence"))
    else:
        vectors = extractor.vectors(sentences)
    used = [F.size(F.filter(b, lambda v: v > 0)).alias(f"used_{b}") for b in features.blocks(extractor.config)]
    return {"raw": vectors.select("doc_id", "sent_idx", *features.SCALARS, *used), "standardized": extractor.standardized(vectors), "pairs": extractor.pairs(vectors)}


def retrieve(sentences: DataFrame, net: models.Network, extractor: features.Extractor, k: int = 3, scale: float = 4.0, window: int = 1, dim: int = 32) -> dict[str, DataFrame]:
    """Of the first 60 sentences of each document: similarities, their range, boundary scores, and the k nearest others."""
    own = sentences.where(F.col("sent_idx") < MOST_RETRIEVED)
    e = retrieval.embedded(retrieval.inputs(extractor.vectors(own), extractor, scale), net)
    similar = metrics.similarities(e.select("doc_id", F.col("sent_idx").alias("idx"), F.lit(0).alias("segment"), F.col("e").alias("x"))).select("doc_id", "query", "other", "similarity")
    return {
        "similarities": similar, "range": similar.groupBy("doc_id").agg(F.min("similarity").alias("least"), F.max("similarity").alias("most")),
        "boundaries": retrieval.boundary_scores(e, dim, window), "nearest": metrics.ranked(similar).where(F.col("rank") <= max(1, min(k, MOST_NEAR))),
    }


def options(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The kinds of models in order, with ``ready`` or why one cannot be used."""
    out = []
    for kind in models.ORDER:
        try:
            models.load(spark, f"{folder}/{kind}")
            out.append((kind, "ready"))
        except (ValueError, models.AnalysisException) as e:
            out.append((kind, str(e).splitlines()[0]))
    return out

