"""Query catalogue of the engine: one query per operator over the timed-text views, each with its SQL where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans import evidence, grading, intervals, runs, scans
from tidemark.plans.runs import rendering_health

MODULES = [runs, intervals, evidence, grading, scans]


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship query."""
    return rendering_health(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
