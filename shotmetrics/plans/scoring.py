"""Training, guarded scoring, and filling the prediction table."""

from __future__ import annotations

import logging
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.calibration import binary_metrics, calibration_curve
from ..operators.features import NUMERIC_FEATURES, with_split
from ..operators.lineage import checkpointed
from ..operators.modeling import BOOST_ROUNDS, fit_boosted, fit_logistic, score
from ..schema import REGULAR_SEASON, ZONE_CATEGORIES
from ..sources.artifacts import ModelStore
from ..sources.tables import ShotStore, in_season, unscored

logger = logging.getLogger(__name__)


class ContextMismatch(ValueError):
    """A model was asked to score a season it was not trained for."""


def _metrics(model, test: DataFrame) -> tuple[dict, DataFrame]:
    scored = score(model, test)
    row = binary_metrics(scored, "p_make", "shot_made_flag").first()
    return {"log_loss": row["log_loss"], "brier_score": row["brier_score"]}, scored


def _levels(model) -> list[str]:
    """Names of the frozen feature columns of a fitted pipeline."""
    labels = model.stages[0].labelsArray
    return NUMERIC_FEATURES + [f"{c}_{v}" for c, vs in zip(ZONE_CATEGORIES, labels, strict=True) for v in vs]


def train_season(
    shots: DataFrame,
    models: ModelStore,
    season: str,
    season_type: str = REGULAR_SEASON,
    rounds: int = BOOST_ROUNDS,
    test_share: float = 0.2,
) -> dict:
    """Fit the baseline and the boosted model of a season; save the latter and its metadata."""
    split = checkpointed(with_split(in_season(shots, season, season_type), test_share))
    sizes = {r["is_test"]: r["count"] for r in split.groupBy("is_test").count().collect()}
    n_train, n_test = sizes.get(False, 0), sizes.get(True, 0)
    if n_train == 0:
        raise ValueError("no shots to train on")
    train, test = split.where(~F.col("is_test")).drop("is_test"), split.where("is_test").drop("is_test")
    baseline = fit_logistic(train, n_train)
    boosted = fit_boosted(train, rounds)
    baseline_metrics, _ = _metrics(baseline, test)
    boosted_metrics, scored = _metrics(boosted, test)
    metadata = {
        "season": season,
        "season_type": season_type,
        "features": _levels(boosted),
        "created_at_utc": datetime.now(UTC).isoformat(),
        "n_shots_total": n_train + n_test,
        "n_train": n_train,
        "n_test": n_test,
        "metrics": {"baseline_logistic": baseline_metrics, "boosted_trees": boosted_metrics},
        "artifacts": models.paths(season, season_type),
    }
    curve = calibration_curve(scored, "p_make", "shot_made_flag") if n_test else None
    models.save(boosted, metadata, curve)
    return metadata


def add_p_make(shots: DataFrame, models: ModelStore, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
    """Score a season's shots with its own model.

    An empty frame comes back empty with the column; a missing model or one
    trained for something else is an error.
    """
    if shots.isEmpty():
        return shots.withColumn("p_make", F.lit(None).cast("double"))
    if not models.exists(season, season_type):
        raise FileNotFoundError(f"no model for {season} {season_type}; train one first")
    trained = models.metadata(season, season_type)
    if (trained["season"], trained["season_type"]) != (season, season_type):
        raise ContextMismatch(
            f"selected=({season}, {season_type}), trained=({trained['season']}, {trained['season_type']})"
        )
    return score(models.model(season, season_type), shots)


def populate_predictions(store: ShotStore, models: ModelStore, cross_season: tuple[str, str] | None = None) -> int:
    """Score every stored shot that has no prediction; returns the rows added.

    Each season and type is scored by its own model and skipped without one.
    With ``cross_season`` that one model scores everything.
    """
    store.initialize()
    if cross_season is not None:
        todo = unscored(store.shots(), store.predictions())
        return store.add_predictions(score(models.model(*cross_season), todo), all_new=True)
    added = 0
    # one entry per season and type
    for season, season_type in sorted(tuple(r) for r in store.shots().select("season", "season_type").distinct().collect()):
        if not models.exists(season, season_type):
            logger.info("no model for %s %s", season, season_type)
            continue
        mine = unscored(
            in_season(store.shots(), season, season_type), in_season(store.predictions(), season, season_type)
        )
        added += store.add_predictions(score(models.model(season, season_type), mine), all_new=True)
    return added
