"""All queries over the test tables, and the SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import books, counts, desk, flows, intake, ledger, runs, views


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return books.QUERIES | ledger.QUERIES | desk.QUERIES | flows.QUERIES | intake.QUERIES | views.QUERIES | counts.QUERIES | runs.QUERIES


def oracle_sql() -> dict[str, str]:
    return books.SQL | ledger.SQL | desk.SQL | flows.SQL | intake.SQL | views.SQL | counts.SQL | runs.SQL | {"markdown_escape": desk.MARKDOWN_ESCAPE}
