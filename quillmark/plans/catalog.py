"""All queries of the engine, and their SQL."""

from __future__ import annotations

from quillmark.plans import evaluation_queries, model_queries, pair_queries, report_queries, sentence_queries  # noqa: F401
from quillmark.plans.base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
