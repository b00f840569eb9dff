"""All registered queries of the library outside llm, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import base, candidate_plans, card_plans, framing_plans, report_plans, seam_plans, search_plans, selection_plans, style_plans, table_plans, timeline_plans  # noqa: F401  the modules register their queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.SQL)
