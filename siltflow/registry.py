"""Every query of the core with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltflow import queries_core, queries_files, queries_ref, sql_core, sql_files, sql_ref


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries_core.QUERIES | queries_ref.QUERIES | queries_files.QUERIES


def oracle_sql() -> dict[str, str]:
    return sql_core.SQL | sql_ref.SQL | sql_files.SQL
