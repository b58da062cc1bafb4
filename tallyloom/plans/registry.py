"""All registered queries of the rubric engine, by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
from tallyloom.plans import records, relations, results, reviews, scores, tables, texts  # noqa: E402

MODULES: tuple = (scores, tables, relations, texts, reviews, results, records)


def queries() -> dict[str, Query]:
    return {name: f for module in MODULES for name, f in module.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
