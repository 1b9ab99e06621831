"""Model artifacts, baseline and monitoring history on a shared file system."""

from __future__ import annotations

import json
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REGULAR_SEASON, REPORT_SCHEMA

_VERSION_SCHEMA = "version string, metadata string"


def type_slug(season_type: str) -> str:
    """'Regular Season' -> 'regular_season'."""
    return season_type.lower().replace(" ", "_")


@dataclass(frozen=True)
class ModelStore:
    """One model, its metadata and its calibration curve per season and type."""

    spark: SparkSession
    base: str

    def paths(self, season: str, season_type: str = REGULAR_SEASON) -> dict[str, str]:
        root = f"{self.base}/season={season}/season_type={type_slug(season_type)}"
        return {k: f"{root}/{k}" for k in ("model", "metadata", "calibration")}

    def _present(self, path: str) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def exists(self, season: str, season_type: str = REGULAR_SEASON) -> bool:
        return self._present(self.paths(season, season_type)["metadata"])

    def save(self, model: PipelineModel, metadata: dict, curve: DataFrame | None = None) -> None:
        """Add a version; readers see it, whole, once its line of metadata is there."""
        p = self.paths(metadata["season"], metadata["season_type"])
        version = f"{datetime.now(UTC):%Y%m%dT%H%M%S%f}"
        model.write().save(f"{p['model']}/{version}")
        if curve is not None:
            curve.write.json(f"{p['calibration']}/{version}")
        line = self.spark.createDataFrame([(version, json.dumps(metadata))], _VERSION_SCHEMA)
        line.coalesce(1).write.mode("append").json(p["metadata"])

    def _newest(self, season: str, season_type: str):
        lines = self.spark.read.schema(_VERSION_SCHEMA).json(self.paths(season, season_type)["metadata"])
        return lines.orderBy(F.desc("version")).first()

    def metadata(self, season: str, season_type: str = REGULAR_SEASON) -> dict:
        return json.loads(self._newest(season, season_type)["metadata"])

    def model(self, season: str, season_type: str = REGULAR_SEASON) -> PipelineModel:
        version = self._newest(season, season_type)["version"]
        return PipelineModel.load(f"{self.paths(season, season_type)['model']}/{version}")

    def calibration(self, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
        version = self._newest(season, season_type)["version"]
        return self.spark.read.json(f"{self.paths(season, season_type)['calibration']}/{version}")


def save_baseline(record: DataFrame, path: str) -> None:
    """Write the one-row baseline record as JSON."""
    record.coalesce(1).write.mode("overwrite").json(path)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def append_report(report: DataFrame, history_path: str, log_path: str) -> None:
    """Append a report to the JSON history and, NaN as null, to the log table."""
    report.write.mode("append").json(history_path)
    logged = report.withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("brier_score", "ece", "log_loss")}
    )
    logged.write.mode("append").parquet(log_path)


def read_history(spark: SparkSession, history_path: str) -> DataFrame:
    return spark.read.schema(REPORT_SCHEMA).json(history_path)


def latest_report(history: DataFrame) -> DataFrame:
    return history.orderBy(F.col("timestamp").desc()).limit(1)


def history_series(history: DataFrame, stamp: str = "timestamp", score: str = "brier_score") -> DataFrame:
    """Run date and Brier score of every report that has one, oldest first."""
    return (
        history.select(F.to_date(stamp).alias("run_date"), F.col(score).alias("brier_score"))
        .dropna(subset=["brier_score"])
        .orderBy("run_date")
    )
