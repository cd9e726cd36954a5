"""Sinks: solutions, the metrics log, level thresholds and ablation tables."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.sources.readers import METRICS


def solutions(rows: DataFrame, path: str) -> None:
    """``solution-problem-N.json`` for each row of ``(doc_id, solution)`` and of a column ``folder``, if there is one, under
    that folder of ``path``. The executors write the files, each under a name of its own and then moved, so that a task that
    runs again replaces them."""
    keys = ["folder"] if "folder" in rows.columns else []
    spark = rows.sparkSession
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    root = path if ":/" in path else f"file://{path}" if default.startswith("file:") else default.rstrip("/") + path

    def write(batches):
        system, base = fs.FileSystem.from_uri(root)
        done = 0
        for batch in batches:
            for row in batch.to_pylist():
                folder = f"{base}/{row['folder']}" if keys else base
                system.create_dir(folder)
                part, name = f"{folder}/.{uuid.uuid4().hex}", f"{folder}/solution-problem-{row['doc_id']}.json"
                with system.open_output_stream(part) as f:
                    f.write(row["solution"].encode())
                system.move(part, name)
                done += 1
        yield pa.RecordBatch.from_pydict({"n": [done]})

    rows.select("doc_id", "solution", *keys).mapInArrow(write, "n long").agg(F.sum("n")).collect()


def append_metrics(spark: SparkSession, path: str, row: dict) -> int:
    """Append a run to the log with the next id; the id. One writer at a time."""
    try:
        last = spark.read.schema(METRICS).json(path).agg(F.max("id")).first()[0] or 0
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = 0
    spark.createDataFrame([row | {"id": last + 1}], METRICS).coalesce(1).write.mode("append").json(path)
    return last + 1


def levels(spark: SparkSession, path: str, thresholds: dict[str, float], comment: str = "") -> None:
    lines = ([f"# {comment}"] if comment else []) + [f"{k}={v!r}" for k, v in sorted(thresholds.items())]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("overwrite").text(path)


def table(rows: DataFrame, path: str) -> None:
    """A CSV table with its header, quoted as in RFC 4180."""
    rows.write.mode("overwrite").csv(path, header=True, quote='"', escape='"')
