"""All core queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framelake.plans import core_queries, media_queries

FLAGSHIP = media_queries.organise_plan


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(core_queries.QUERIES) | media_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(core_queries.ORACLE_SQL) | media_queries.ORACLE_SQL
