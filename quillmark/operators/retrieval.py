"""The retrieval model: an embedding of sentences learned from triplets, the window and threshold of its boundary scores, and
what it is measured against."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.config import FeatureConfig
from quillmark.operators import features, metrics, models, segments
from quillmark.operators.models import Network, TripletPolicy


@dataclass(frozen=True)
class Settings:
    """What the model is trained with where nothing else is asked."""

    features: FeatureConfig = field(default_factory=FeatureConfig)
    hidden: tuple[int, ...] = (128,)
    dim: int = 32
    epochs: int = 30
    triplets: int = 20_000
    batch: int = 64
    rate: float = 1e-3
    margin: float = 0.5
    l2: float = 1e-4
    policy: TripletPolicy = field(default_factory=TripletPolicy)
    patience: int = 5
    profile_scale: float = 4.0
    windows: tuple[int, ...] = (1, 2, 3)
    most_sentences: int = 150_000
    seed: int = 42


def inputs(vectors: DataFrame, extractor: features.Extractor, scale: float) -> DataFrame:
    """``vectors`` with ``x``: z-scores and scaled roots of the blocks' shares."""
    z = [F.least(F.greatest((F.col(c) - m) / s, F.lit(-5.0)), F.lit(5.0)).cast("float") for c, (m, s) in extractor.scaler.items()]
    roots = [F.transform(b, lambda v: (F.sqrt(v) * scale).cast("float")) for b in features.blocks(extractor.config)]
    return vectors.withColumn("x", F.concat(F.array(*z), *roots)).drop(*features.SCALARS, *features.blocks(extractor.config))


def embedded(rows: DataFrame, net: Network | None, dim: int = 0, seed: int = 7, name: str = "e") -> DataFrame:
    """``rows`` with the unit vector of ``x``: the network's, the raw one without a network, or a random one of ``dim``."""

    def run(batches):
        for batch in batches:
            x = np.array(batch.column(batch.schema.get_field_index("x")).to_pylist(), np.float64).reshape(batch.num_rows, -1)
            if dim:
                keys = batch.column(batch.schema.get_field_index("__seed")).to_pylist()
                e = np.concatenate([models.random_units(1, dim, k & 0xFFFFFFFF) for k in keys]) if keys else np.zeros((0, dim))
            else:
                e = models.unit(net.forward(x)[0] if net else x)
            yield pa.RecordBatch.from_pydict({f: batch.column(k) for k, f in enumerate(batch.schema.names) if f != "__seed"} | {name: pa.array(e.tolist(), pa.list_(pa.float64()))})

    own = rows.withColumn("__seed", F.xxhash64(F.lit(seed), "doc_id", "sent_idx")) if dim else rows
    return own.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))]))


def boundary_scores(vectors: DataFrame, dim: int, window: int, *keep: str) -> DataFrame:
    """Boundary scores of the array column ``e``, with other columns of the boundary's first sentence."""
    flat = vectors.select("doc_id", "sent_idx", *[F.col("e")[k].alias(f"e{k}") for k in range(dim)])
    out = segments.boundary_scores(flat, [f"e{k}" for k in range(dim)], window)
    return out.join(vectors.select("doc_id", "sent_idx", *keep), ["doc_id", "sent_idx"]) if keep else out


def _switches(vectors: DataFrame, dim: int, window: int) -> DataFrame:
    truth = vectors.select("doc_id", (F.col("sent_idx") - 1).alias("sent_idx"), F.col("change").alias("label")).where("sent_idx >= 0")
    return boundary_scores(vectors, dim, window).join(truth, ["doc_id", "sent_idx"])


def best_window(vectors: DataFrame, dim: int, windows: tuple[int, ...]) -> tuple[int, float, float]:
    """The window with the best AUC (the first of equals), that AUC, and the best threshold of its scores."""
    found = []
    for w in windows:
        scored = _switches(vectors, dim, w).withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))
        found.append((w, float(metrics.auc(scored).first().auc), scored))
    w, area, scored = max(found, key=lambda x: x[1])
    return w, area, float(metrics.best_threshold(scored).first().threshold)


@dataclass(frozen=True)
class Result:
    network: Network
    extractor: features.Extractor
    window: int
    validation_auc: float
    threshold: float
    measures: dict[str, dict[str, float]]  # learned, raw, random


def train(sentences: DataFrame, settings: Settings = Settings(), **lists) -> tuple[Network, features.Extractor]:
    """``sentences(doc_id, sent_idx, sentence, change, authors)``: the extractor of all of them, and a network that learned
    from whole documents, chosen by hash, of about ``most_sentences`` sentences. A fifth of these documents says when to stop."""
    extractor, vectors = features.fit(segments.segment_ids(sentences), settings.features, **lists)
    x = inputs(vectors, extractor, settings.profile_scale)
    part = min(1.0, settings.most_sentences / max(1, sentences.count()))
    own = x.where(F.pmod(F.xxhash64(F.lit(settings.seed), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20)))
    table = own.select("doc_id", "sent_idx", "segment", "authors", "x").toArrow().sort_by([("doc_id", "ascending"), ("sent_idx", "ascending")])
    docs, segs = table.column("doc_id").to_pylist(), table.column("segment").to_pylist()
    rows = [(d, s, k) for k, (d, s) in enumerate(zip(docs, segs))]
    authors = dict(zip(docs, (a or 0 for a in table.column("authors").to_pylist())))
    matrix = np.array(table.column("x").to_pylist(), np.float64).reshape(len(rows), -1)
    number = {d: k for k, d in enumerate(dict.fromkeys(docs))}
    kept, held = ([r for r in rows if (number[r[0]] % 5 == 0) == h] for h in (False, True))
    net = models.fit_embedding(
        matrix, models.draw_triplets(kept, settings.triplets, settings.policy, authors, settings.seed), settings.hidden, settings.dim, settings.epochs, settings.batch, settings.rate, settings.margin,
        settings.l2, settings.patience, settings.seed, (matrix, models.draw_triplets(held, settings.triplets // 10, settings.policy, authors, settings.seed + 1)),
    )
    return net, extractor


def run(training: DataFrame, validation: DataFrame, test: DataFrame | None = None, settings: Settings = Settings(), **lists) -> Result:
    """Trains on the first table, chooses the window by AUC and the threshold on the second, and measures on the third, if
    there is one, else on the second: the learned vectors, the raw ones with a window and threshold of their own, and random ones."""
    net, extractor = train(training, settings, **lists)

    def prepared(sentences: DataFrame) -> DataFrame:
        return inputs(extractor.vectors(segments.segment_ids(sentences), "segment", "change", "authors"), extractor, settings.profile_scale)

    own, report = prepared(validation).persist(), None
    report = prepared(test).persist() if test is not None else own
    wide = len(extractor.scaler) + sum(features.blocks(extractor.config).values())
    measures, chosen = {}, None
    for name, network, dim, random in (("learned", net, settings.dim, 0), ("raw", None, wide, 0), ("random", None, settings.dim, settings.dim)):
        window, area, cut = best_window(embedded(own, network, random), dim, settings.windows)
        chosen = chosen or (window, area, cut)
        vectors = embedded(report, network, random)
        measures[name] = measured(vectors, dim, window, cut)
    own.unpersist(), report.unpersist()
    return Result(net, extractor, *chosen, measures)


def measured(vectors: DataFrame, dim: int, window: int, threshold: float) -> dict[str, float]:
    """Switch detection, author counts and ranked retrieval of embedded sentences."""
    scored = _switches(vectors, dim, window)
    c = metrics.confusion(scored, threshold=float(threshold)).first()
    pairs = metrics.similarities(vectors.select("doc_id", F.col("sent_idx").alias("idx"), "segment", F.col("e").alias("x")))
    r = metrics.retrieval(pairs).first()
    estimated = scored.groupBy("doc_id").agg((1 + F.count_if(F.col("score") > threshold)).alias("estimated"))
    a = metrics.author_counts(estimated.join(vectors.groupBy("doc_id").agg(F.max("authors").alias("authors")), "doc_id")).first()
    area = metrics.auc(scored.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")))).first().auc
    return {"macro_f1": c.macro_f1, "auc": area, "p_at_1": r.p_at_1, "recall_at_5": r.recall_at_5, "mrr": r.mrr, "map": r["map"], "exact_authors": a.exact, "author_error": a.mae}
