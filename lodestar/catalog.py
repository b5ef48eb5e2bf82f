"""All queries over the given tables by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import books, filters, grids, indicators, markets, oscillators, patterns, quality, records, rules, sessions, strategies
from lodestar.plans.common import settled_sql

_MODULES = (patterns, indicators, filters, oscillators, quality, strategies, rules, sessions, books, records, markets, grids)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: settled_sql(v) for m in _MODULES for k, v in m.ORACLE_SQL.items()}
