"""The queries of the library's own operators and their SQL, for __spark_entry__."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .registry import ORACLE, QUERIES

for _name in ("log_queries", "plate_queries", "motion_queries", "space_queries", "grid_queries", "measure_queries", "request_queries", "stellar_queries", "ingest_queries", "basic_queries", "stream_queries"):
    import_module(f".plans.{_name}", __package__)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
