"""All non-llm queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textquarry.plans import similarity_queries, site_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**similarity_queries.QUERIES, **site_queries.QUERIES}
ORACLES: dict[str, str] = {**similarity_queries.ORACLES, **site_queries.ORACLES}
