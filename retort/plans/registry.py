"""The queries by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retort.plans import model_queries, signal_queries, source_queries, table_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**signal_queries.QUERIES, **table_queries.QUERIES, **model_queries.QUERIES, **source_queries.QUERIES}
ORACLES: dict[str, str] = {**signal_queries.ORACLES, **table_queries.ORACLES, **model_queries.ORACLES, **source_queries.ORACLES}
