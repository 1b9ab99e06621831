"""Running a saved SQL text with bound parameters."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def register_views(shots: DataFrame, predictions: DataFrame) -> None:
    """Offer the tables to SQL as ``shots`` and ``predictions``."""
    shots.createOrReplaceTempView("shots")
    predictions.createOrReplaceTempView("predictions")


def run_sql(spark: SparkSession, text: str, args: dict[str, Any] | list | None = None) -> DataFrame:
    """Run a SQL text with bound parameters (:name with a dict, ? with a list)."""
    return spark.sql(text, args=args) if args else spark.sql(text)


def run_sql_file(spark: SparkSession, path: str | Path, args: dict[str, Any] | list | None = None) -> DataFrame:
    return run_sql(spark, Path(path).read_text(encoding="utf-8"), args)
