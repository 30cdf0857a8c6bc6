"""The queries of the reference's operators over the test tables, each with an equivalent in SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import evaluation, measures, preparation, shaping
from .base import registered, sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(registered)


def oracle_sql() -> dict[str, str]:
    return dict(sql)


__all__ = ["evaluation", "measures", "oracle_sql", "preparation", "queries", "shaping"]
