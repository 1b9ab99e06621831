"""Expected-make models: fit, score, measure."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import boosting, newton
from .features import feature_stages, model_frame

SEED = 42
# Settings of the boosted model.
BOOST_ROUNDS = 350
BOOST_RATE = 0.05
BOOST_DEPTH = 6
BOOST_ROWS = 0.9
BOOST_COLUMNS = 0.9
BOOST_MIN_WEIGHT = 2.0
BOOST_L2 = 1.0


def fit_logistic(train: DataFrame, n_rows: int, max_iter: int = 100) -> PipelineModel:
    """Baseline: logistic regression with a unit ridge on the summed loss, solved by Newton steps (operators/newton.py)."""
    rows = model_frame(train)
    features = feature_stages().fit(rows)
    model = newton.fit(features.transform(rows), l2=1.0, max_steps=max_iter)
    return PipelineModel(stages=[*features.stages, model])


def fit_boosted(train: DataFrame, rounds: int = BOOST_ROUNDS, depth: int = BOOST_DEPTH) -> PipelineModel:
    """Second-order histogram boosting on logistic loss (operators/boosting.py), after the feature stages.

    All labelled rows are fitted; those with equal binned features are counted
    together, over all of the session's shuffle tasks.
    """
    rows = model_frame(train)
    features = feature_stages().fit(rows)
    key = "shot_id" if "shot_id" in train.columns else None
    boosted = boosting.fit(
        features.transform(rows),
        rounds=rounds,
        depth=depth,
        rate=BOOST_RATE,
        lam=BOOST_L2,
        min_child_weight=BOOST_MIN_WEIGHT,
        row_share=BOOST_ROWS,
        column_share=BOOST_COLUMNS,
        seed=SEED,
        key=key,
    )
    return PipelineModel(stages=[*features.stages, boosted])


def score(model: PipelineModel, shots: DataFrame) -> DataFrame:
    """The shots as they are, with p_make added."""
    packed = shots.select(F.struct(*shots.columns).alias("_row"), "*")
    out = model.transform(model_frame(packed))
    return out.select("_row.*", vector_to_array("probability")[1].alias("p_make"))
