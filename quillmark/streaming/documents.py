"""Streams: whole documents are measured micro-batch by micro-batch; sentences that arrive one by one keep a state for each document."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillmark.functions import scalars

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def read_documents(spark: SparkSession, path: str, files_each: int = 16) -> DataFrame:
    return spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_each).parquet(path)


def measured(documents: DataFrame, groups: list[str] | None = None) -> DataFrame:
    """Scalars of every sentence; no state, so it is the same on a stream and on a table."""
    return scalars.of_documents(documents, groups)


def segment_stream(decided: DataFrame, minutes: int = 60) -> DataFrame:
    """``decided(doc_id, sent_idx, change, ts)`` as a stream: each sentence with its segment, which counts the document's changes.

    Sentences of a document must come in order across micro-batches. A document's state goes when nothing has come for
    ``minutes``.
    """

    def run(key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count = state.get[0] if state.exists else 0
        for rows in parts:
            rows = rows.sort_values("sent_idx")
            segment = rows["change"].fillna(0).astype(int).cumsum() + count
            count = int(segment.iloc[-1]) if len(segment) else count
            yield pd.DataFrame({"doc_id": key[0], "sent_idx": rows["sent_idx"], "segment": segment})
        state.update((count,))
        state.setTimeoutDuration(minutes * 60_000)

    return decided.groupBy("doc_id").applyInPandasWithState(run, "doc_id long, sent_idx int, segment int", "count int", "append", GroupStateTimeout.ProcessingTimeTimeout)
