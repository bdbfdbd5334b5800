"""All core queries by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import data_quality, decisions, evaluation, governance, ingestion, screening

FLAGSHIP = "screen_threshold_status"
MODULES = [data_quality, screening, evaluation, governance, ingestion, decisions]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
