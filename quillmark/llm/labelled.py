"""A bounded sample of labelled documents, and the queries' fold rule."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import crc_residue

FOLDS, HELD_OUT = 4, 2


def held_out():
    return F.coalesce(crc_residue("doc_id", FOLDS) == HELD_OUT, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """``(doc_id, text, fold, y)`` of about ``most`` labelled documents at most, outside the held-out fold, chosen by hash.

    A document with several label rows has the largest label; null labels and ids are left out. The sample's ids are
    sent to the executors: there are at most about ``most`` of them.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    total = rows.count()
    if total > most:
        rows = rows.where(F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(1 << 20)) < int(most / total * (1 << 20)))
    rows = rows.withColumn("fold", crc_residue("doc_id", FOLDS).cast("int"))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 60, weights: np.ndarray | None = None) -> np.ndarray:
    """Newton's method for ridge logistic regression; the columns of x include the constant, if any."""
    w = np.zeros(x.shape[1])
    c = np.ones(len(y)) if weights is None else weights
    for _ in range(steps):
        p = sigmoid(x @ w)
        gradient = x.T @ (c * (p - y)) / c.sum() + ridge * w
        curvature = (x * (c * p * (1 - p))[:, None]).T @ x / c.sum() + ridge * np.eye(len(w))
        step = np.linalg.solve(curvature, gradient)
        size = np.abs(step).max()
        w -= step * min(1.0, 4.0 / max(size, 1e-12))
        if size < 1e-8:
            break
    return w
