"""Reports on runs: the latest of each model, importance of feature groups, averages over seeds, best values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each model and source, the later id where times are equal; ordered by macro-F1."""
    order = Window.partitionBy("model", "source").orderBy(F.desc("trained_at"), F.desc("id"))
    return runs.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k").orderBy(F.desc("macro_f1"), "id")


def importances(runs: DataFrame, baseline: str = "ALL", least: float = 0.005) -> DataFrame:
    """What each model loses without a group, and whether that is beyond ``least`` and two deviations."""
    base = runs.where(F.col("experiment") == baseline).select("model", F.col("macro_f1").alias("base"))
    lost = F.col("base") - F.col("macro_f1")
    bound = F.greatest(F.lit(least), 2 * F.col("sd"))
    verdict = F.when(lost > bound, "helps").when(lost < -bound, "hurts").otherwise("neutral")
    return runs.where(F.col("experiment").startswith(f"{baseline} - ")).join(base, "model").select("model", "experiment", lost.alias("importance"), verdict.alias("verdict"))


def over_seeds(results: DataFrame, *measures: str) -> DataFrame:
    """Mean and sample deviation of each measure by experiment, 0 for one seed."""
    parts = [x for m in measures for x in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))]
    return results.groupBy("model", "experiment").agg(F.count("*").alias("seeds"), *parts)


def best_values(results: DataFrame) -> DataFrame:
    """For each model and parameter the value with the best validation score, the first by name where equal."""
    order = Window.partitionBy("model", "param").orderBy(F.desc("val_macro_f1"), "value")
    return results.withColumn("__k", F.row_number().over(order)).where("__k = 1").select("model", "param", "value", "val_macro_f1")


def history(runs: DataFrame, model: str) -> DataFrame:
    """All runs of a model, the last first."""
    return runs.where(F.col("model") == model).orderBy(F.desc("trained_at"), F.desc("id"))


def latest_for(runs: DataFrame, model: str) -> DataFrame:
    """The last run of a model, whatever its source."""
    return history(runs, model).limit(1)


def importance_by_level(runs: DataFrame, *levels: str, baseline: str = "ALL") -> DataFrame:
    """What leaving out a group costs each level, averaged over the models: ``(experiment, models, a column for each level)``."""
    base = runs.where(F.col("experiment") == baseline).select("model", *[F.col(c).alias(f"base_{c}") for c in levels])
    lost = runs.where(F.col("experiment").startswith(f"{baseline} - ")).join(base, "model")
    return lost.groupBy("experiment").agg(F.count("*").alias("models"), *[F.avg(F.col(f"base_{c}") - F.col(c)).alias(c) for c in levels])


def across_models(runs: DataFrame, models: tuple[str, ...], measure: str = "macro_f1") -> DataFrame:
    """A row for each experiment with a column for each model, and their mean."""
    mean = runs.groupBy("experiment").agg(F.avg(measure).alias("mean"))
    return runs.groupBy("experiment").pivot("model", list(models)).agg(F.avg(measure)).join(mean, "experiment")


def grid(runs: DataFrame, rows: str, columns: str, values: tuple, measure: str = "macro_f1") -> DataFrame:
    """A measure by two parameters, as a table: depth by least leaf, for one."""
    return runs.groupBy(rows).pivot(columns, list(values)).agg(F.avg(measure))


def markdown(table: DataFrame, digits: int = 4) -> str:
    """A small table as text."""
    cell = lambda v: f"{v:.{digits}f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = [f"| {' | '.join(table.columns)} |", f"|{'---|' * len(table.columns)}"]
    return "\n".join([*lines, *(f"| {' | '.join(map(cell, r))} |" for r in table.collect())])
