from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from shotmetrics.operators import modeling
from shotmetrics.operators.features import with_split
from shotmetrics.plans import scoring
from shotmetrics.sources.artifacts import ModelStore, type_slug
from shotmetrics.sources.tables import ShotStore

SEASON = "1997-98"


@pytest.fixture(scope="module")
def trained(spark, scored_rows, tmp_path_factory):
    models = ModelStore(spark, str(tmp_path_factory.mktemp("models")))
    metadata = scoring.train_season(scored_rows.drop("p_make"), models, SEASON, rounds=5)
    return models, metadata


def test_training_saves_model_and_metadata(trained, scored_rows):
    models, metadata = trained
    rows = scored_rows.where((F.col("season") == SEASON) & (F.col("season_type") == "Regular Season"))
    assert metadata["n_train"] + metadata["n_test"] == metadata["n_shots_total"] == rows.count()
    assert models.exists(SEASON) and not models.exists("1900-01")
    assert models.metadata(SEASON) == metadata
    assert metadata["features"][:5] == ["loc_x", "loc_y", "distance", "angle", "is_3"]
    assert "shot_zone_basic_Mid-Range" in metadata["features"]
    assert set(metadata["metrics"]) == {"baseline_logistic", "boosted_trees"}
    assert models.calibration(SEASON).count() >= 2
    assert models.paths(SEASON)["model"].endswith("season=1997-98/season_type=regular_season/model")
    assert type_slug("Regular Season") == "regular_season"


def test_models_beat_the_base_rate(scored_rows):
    split = with_split(scored_rows.drop("p_make"))
    train, test = split.where(~F.col("is_test")), split.where("is_test")
    rate = train.agg(F.avg("shot_made_flag")).first()[0]
    y = [r[0] for r in test.select("shot_made_flag").collect()]
    base = -sum(math.log(rate if v else 1 - rate) for v in y) / len(y)
    for model in (modeling.fit_logistic(train, train.count()), modeling.fit_boosted(train, rounds=8, depth=3)):
        metrics, scored = scoring._metrics(model, test)
        assert metrics["log_loss"] <= base
        assert scored.where(~F.col("p_make").between(0, 1)).isEmpty()
        assert scored.columns == [*test.columns, "p_make"]


def test_scoring_guards(trained, scored_rows):
    models, metadata = trained
    shots = scored_rows.drop("p_make").where(F.col("season") == SEASON)
    assert scoring.add_p_make(shots, models, SEASON).where("p_make is null").isEmpty()
    none = scoring.add_p_make(shots.where("player_id < 0"), models, SEASON)
    assert none.isEmpty() and none.columns[-1] == "p_make"
    with pytest.raises(FileNotFoundError):
        scoring.add_p_make(shots, models, "1996-97")


def test_mismatched_model_is_refused(trained, scored_rows, spark, tmp_path):
    models, metadata = trained
    other = ModelStore(spark, str(tmp_path / "m"))
    other.save(models.model(SEASON), metadata)
    moved = ModelStore(spark, str(tmp_path / "m2"))
    p = moved.paths("2000-01")
    models.model(SEASON).write().save(p["model"])
    spark.read.text(other.paths(SEASON)["metadata"]).write.text(p["metadata"])
    with pytest.raises(scoring.ContextMismatch):
        scoring.add_p_make(scored_rows.drop("p_make"), moved, "2000-01")


def test_training_without_rows(scored_rows, trained):
    with pytest.raises(ValueError, match="no shots"):
        scoring.train_season(scored_rows, trained[0], "1900-01")


def test_predictions_fill_once_and_per_season(spark, scored_rows, trained, tmp_path):
    models, _ = trained
    store = ShotStore(spark, str(tmp_path / "store"))
    some = scored_rows.drop("p_make", "shot_id").where(F.col("season").isin(SEASON, "1996-97"))
    n = store.upsert(some)
    own = some.where((F.col("season") == SEASON) & (F.col("season_type") == "Regular Season")).count()
    assert scoring.populate_predictions(store, models) == own
    assert scoring.populate_predictions(store, models) == 0
    assert scoring.populate_predictions(store, models, cross_season=(SEASON, "Regular Season")) == n - own
    assert store.predictions().select("shot_id").distinct().count() == n
    joined = store.shots().join(store.predictions(), "shot_id")
    assert joined.where("shot_made_flag <> actual_make").isEmpty()
