"""The monitoring job: baseline, report, alert, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_half_away
from ..operators.calibration import calibration_metrics
from ..operators.drift import (
    CATEGORY_DRIFT,
    NUMERIC_DRIFT,
    PSI_WARN,
    category_shares,
    drift_map,
    drift_report,
    feature_profile,
    largest_season,
    recent_window,
)
from ..operators.lineage import checkpointed
from ..schema import REGULAR_SEASON, REPORT_SCHEMA
from ..sources.artifacts import append_report, load_baseline, save_baseline

BRIER_FACTOR = 1.15
METRICS = ["brier_score", "ece", "log_loss"]


def _outcome(scored: DataFrame) -> str:
    """The outcome stored with the prediction where the rows carry it."""
    return "actual_make" if "actual_make" in scored.columns else "shot_made_flag"


def baseline_record(scored: DataFrame, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
    """One row: size, metrics and feature distributions of a scored season."""
    rows = scored.where((F.col("season") == season) & (F.col("season_type") == season_type))
    metrics = calibration_metrics(rows, "p_make", _outcome(rows))
    percents = ["p10", "p25", "p50", "p75", "p90"]
    # a handful of features and their categories
    numbers = feature_profile(rows).agg(
        F.map_from_entries(
            F.sort_array(F.collect_list(F.struct("feature", F.struct("mean", "std", *percents).alias("profile"))))
        )
    )
    shares = (
        category_shares(rows)
        .groupBy("feature")
        .agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "share")))).alias("shares"))
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "shares"))))
    )
    return metrics.select(
        F.lit(season).alias("season"),
        F.lit(season_type).alias("season_type"),
        F.col("n_predictions").alias("n_shots"),
        *[round_half_away(F.col(c), 6).alias(c) for c in METRICS],
        numbers.scalar().alias("numeric_distributions"),
        shares.scalar().alias("category_distributions"),
    )


def alert_columns(brier: Column, baseline: Column, drift: Column) -> tuple[Column, Column]:
    """(alert_triggered, alert_message) from the metrics and the drift map."""
    limit = baseline * F.lit(BRIER_FACTOR)
    worse = F.coalesce(brier > limit, F.lit(False))
    said = F.format_string(
        "Brier score %.4f exceeds baseline %.4f × 1.15 (%.4f).", brier, baseline, limit
    )
    parts = [F.when(worse, said)]
    hit = worse
    for name in [*NUMERIC_DRIFT, *CATEGORY_DRIFT]:
        bad = F.coalesce(drift[name]["status"] == "alert", F.lit(False))
        text = F.format_string(f"Feature '{name}' PSI = %.4f (> {PSI_WARN}).", drift[name]["psi"])
        parts.append(F.when(bad, text))
        hit = hit | bad
    return hit, F.when(hit, F.concat_ws(" ", *parts)).otherwise("All checks passed.")


def monitoring_report(
    scored: DataFrame,
    baseline_brier: float | None = None,
    season: str | None = None,
    season_type: str = REGULAR_SEASON,
    window_days: int | None = 30,
    baseline_shots: DataFrame | None = None,
    dates: DataFrame | None = None,
) -> DataFrame:
    """One report row on the newest days of the scored shots in scope.

    Drift is measured against ``baseline_shots``, by default all scored shots
    of the same season (of all seasons without one); ``dates`` is as for
    ``recent_window``. Without any row in the window the metrics are null and
    the message says so.
    """
    recent = checkpointed(
        recent_window(scored, window_days, season, season_type, dates).select(
            "p_make", _outcome(scored), *NUMERIC_DRIFT, *CATEGORY_DRIFT
        )
    )
    if baseline_shots is None:
        baseline_shots = scored
        if season is not None:
            baseline_shots = scored.where((F.col("season") == season) & (F.col("season_type") == season_type))
    metrics = calibration_metrics(recent, "p_make", _outcome(scored))
    drift = drift_map(drift_report(recent, baseline_shots)).scalar()
    row = metrics.withColumns(
        {"drift_report": drift, "baseline_brier": F.lit(baseline_brier).cast("double")}
    )
    hit, text = alert_columns(F.col("brier_score"), F.col("baseline_brier"), F.col("drift_report"))
    some = F.col("n_predictions") > 0
    nothing = f"No predictions found in the last {window_days} days."
    return row.select(
        F.current_timestamp().alias("timestamp"),
        F.lit(season or "all").alias("season"),
        F.lit(season_type).alias("season_type"),
        *[round_half_away(F.col(c), 6).alias(c) for c in METRICS],
        "n_predictions",
        F.when(some, F.col("drift_report")).alias("drift_report"),
        (some & hit).alias("alert_triggered"),
        F.when(some, text).otherwise(nothing).alias("alert_message"),
        F.when(some, F.col("baseline_brier")).alias("baseline_brier"),
    ).select(*REPORT_SCHEMA.names)


# The season that stands for an empty table.
NO_SEASON = ("2023-24", REGULAR_SEASON)


def establish_baseline(
    scored: DataFrame, path: str, season: str | None = None, season_type: str = REGULAR_SEASON
) -> DataFrame:
    """Measure a season, by default the one with most shots, save it as the baseline and return it.

    With no shots at all the record names a fixed season and counts none.
    """
    if season is None:
        best = largest_season(scored).first()
        season, season_type = (best["season"], best["season_type"]) if best else NO_SEASON
    record = checkpointed(baseline_record(scored, season, season_type))
    save_baseline(record, path)
    return record


def run_monitoring(
    scored: DataFrame, history_path: str, log_path: str, baseline_path: str | None = None, **options
) -> DataFrame:
    """Make a report, append it to history and log, and return it.

    The Brier score of the baseline stored at ``baseline_path`` is the one to
    compare with unless ``baseline_brier`` gives another.
    """
    if baseline_path is not None and options.get("baseline_brier") is None:
        stored = load_baseline(scored.sparkSession, baseline_path)
        if "brier_score" in stored.columns:
            options["baseline_brier"] = stored.first()["brier_score"]
    report = checkpointed(monitoring_report(scored, **options))
    append_report(report, history_path, log_path)
    return report
