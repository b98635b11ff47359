"""Named queries over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import depth_queries, inference_queries, moment_queries, relational_queries, source_queries, stage_queries, structural_queries  # noqa: F401  (they register)
    from .panel_queries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import depth_queries, inference_queries, moment_queries, relational_queries, source_queries, stage_queries, structural_queries  # noqa: F401  (they register)
    from .panel_queries import SQL

    return dict(SQL)
