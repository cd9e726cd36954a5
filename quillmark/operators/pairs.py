"""Scaling of sentence vectors, and pairs of neighbouring sentences by a window, never by a self-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-8
ORDER = ("doc_id", "sent_idx")


def fit_scaler(vectors: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of each column, in one aggregate; deviations under 1e-12 are 1."""
    row = vectors.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (row[f"m_{c}"] or 0.0, s if (s := row[f"s_{c}"] or 0.0) >= 1e-12 else 1.0) for c in columns}


def zscore(column: str, scale: tuple[float, float], clip: float = 5.0) -> Column:
    z = (F.col(column) - F.lit(scale[0])) / F.lit(scale[1])
    return F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)) if clip else z


def neighbours(vectors: DataFrame, columns: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """A row for each neighbouring pair: ``doc_id``, ``sent_idx`` of the first, columns as ``a_*`` and ``b_*``."""
    order = Window.partitionBy(ORDER[0]).orderBy(ORDER[1])
    ahead = vectors.select(*ORDER, *keep, *[F.col(c).alias(f"a_{c}") for c in columns], *[F.lead(c).over(order).alias(f"b_{c}") for c in columns], F.lead(ORDER[1]).over(order).alias("__next"))
    return ahead.where("__next IS NOT NULL").drop("__next")


def represented(column: str, representation: str, raw: str = "raw_") -> dict[str, Column]:
    """A scalar's part of the pair vector, from its z-scores in a_ and b_; RELATIVE reads the raw values."""
    a, b = F.col(f"a_{column}"), F.col(f"b_{column}")
    gap, mean = F.abs(a - b), (a + b) / 2
    if representation == "RELATIVE":
        x, y = F.col(f"a_{raw}{column}"), F.col(f"b_{raw}{column}")
        return {f"rel_{column}": F.abs(x - y) / (F.abs(x) + F.abs(y) + F.lit(EPSILON))}
    parts = {
        "ABSOLUTE": {"abs": gap}, "SIGNED": {"diff": a - b}, "MEAN": {"mean": mean}, "ABSOLUTE_AND_MEAN": {"abs": gap, "mean": mean},
        "CONCAT": {"first": a, "second": b, "abs": gap}, "ABSOLUTE_AND_PRODUCT": {"abs": gap, "product": a * b},
    }
    if representation not in parts:
        raise ValueError(f"unknown representation {representation}")
    return {f"{k}_{column}": v for k, v in parts[representation].items()}


def overall_distance(columns: list[str]) -> Column:
    """Root mean square of the z-score differences."""
    return F.sqrt(sum(((F.col(f"a_{c}") - F.col(f"b_{c}")) * (F.col(f"a_{c}") - F.col(f"b_{c}")) for c in columns), F.lit(0.0)) / len(columns))


def embedding_input(columns: list[str], fitted: dict[str, tuple[float, float]], profile: str, scale: float = 4.0, clip: float = 5.0) -> Column:
    """What the embedding network reads, as 32-bit floats: z-scores, then the roots of the profile's shares times ``scale``."""
    z = F.array(*[zscore(c, fitted[c], clip).cast("float") for c in columns])
    return F.concat(z, F.transform(profile, lambda v: (F.sqrt(F.greatest(F.lit(0.0), v)) * scale).cast("float")))


def bucket_differences(profile: str) -> Column:
    """Absolute differences of two profiles, bucket by bucket, for full pair vectors."""
    return F.zip_with(f"a_{profile}", f"b_{profile}", lambda x, y: F.abs(x - y))
