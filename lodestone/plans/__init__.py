"""Registered queries of the engine: one module per family, each with QUERIES and ORACLES."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, blocks, graphs, ingest, relational, scalar, search

FAMILIES = (scalar.family, relational.family, search.family, blocks.family, analytics.family, graphs.family, ingest.family)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for family in FAMILIES for name, run in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
