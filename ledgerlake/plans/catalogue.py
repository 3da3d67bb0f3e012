"""Catalogue of named queries over the driver tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import curation, evidence, model, rules, textual
from .registry import QUERIES, SQL

PARTS = (model, curation, textual, evidence, rules)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
