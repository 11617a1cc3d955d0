"""Registered queries of the takeoff operators, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bill_queries, read_queries

FLAGSHIP = "priced_bill"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**bill_queries.QUERIES, **read_queries.QUERIES}
ORACLES: dict[str, str] = {**bill_queries.ORACLES, **read_queries.ORACLES}
