"""Fitted models. Their values have no SQL twin; split sizes and labels do."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import causal, modeling
from ..operators.calibration import binary_metrics
from ..operators.features import with_split
from ..operators.lineage import checkpointed, written
from ..sources.star_schema import shots
from .base import fixture_sql, joined, query

_fitted: dict[tuple[str, str], tuple] = {}


def _split(spark, sf_dir):
    # The shots are derived once; finding the test groups reads them several times.
    rows = written(with_split(written(shots(spark, sf_dir))))
    return rows.where(~F.col("is_test")).drop("is_test"), rows.where("is_test").drop("is_test")


def _models(spark, sf_dir):
    """Both models, trained once for a session and table folder and then applied, as the jobs do."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        train, test = _split(spark, sf_dir)
        models = {
            "baseline_logistic": modeling.fit_logistic(train, train.count()),
            "boosted_trees": modeling.fit_boosted(train),
        }
        _fitted[key] = models, train, test
    return _fitted[key]


@query("score_logistic")
def score_logistic(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    model = modeling.fit_logistic(train, train.count())
    return modeling.score(model, train.unionByName(test)).select("shot_id", "shot_made_flag", "p_make")


@query("score_boosted")
def score_boosted(spark, sf_dir):
    models, train, test = _models(spark, sf_dir)
    scored = modeling.score(models["boosted_trees"], train.unionByName(test))
    return scored.select("shot_id", "shot_made_flag", "p_make")


@query("model_metrics")
def model_metrics(spark, sf_dir):
    models, _, test = _models(spark, sf_dir)
    rows = [
        binary_metrics(modeling.score(m, test), "p_make", "shot_made_flag").select(F.lit(name).alias("model"), "*")
        for name, m in models.items()
    ]
    return rows[0].unionByName(rows[1])


# The score equation of an unpenalised intercept holds to the optimiser's tolerance;
# trees that stop after a set number of rounds come close to the mean.
_MEAN_TOLERANCE = {"baseline_logistic": 1e-4, "boosted_trees": 0.01}


@query(
    "model_checks",
    f"""{fixture_sql()}
SELECT model, count(*) AS n_scored, 0::BIGINT AS n_outside, true AS beats_base_rate, true AS mean_matches
FROM shots, (VALUES ('baseline_logistic'), ('boosted_trees')) AS m(model) GROUP BY 1""",
)
def model_checks(spark, sf_dir):
    """What must hold of any fit: all rows scored inside (0, 1), better than the base rate, right on average."""
    models, train, test = _models(spark, sf_dir)
    marked = train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))
    p, y = F.col("p_make"), F.col("shot_made_flag").cast("double")
    loss = F.when(F.col("is_test"), -(y * F.log(p) + (1 - y) * F.log(1 - p)))
    out = None
    for name, model in models.items():
        seen = modeling.score(model, marked).agg(
            F.count("p_make").alias("n_scored"),
            F.count_if((p <= 0) | (p >= 1)).alias("n_outside"),
            F.avg(loss).alias("loss"),
            F.avg(F.when(F.col("is_test"), y)).alias("rate"),
            F.abs(F.avg(F.when(~F.col("is_test"), p - y))).alias("gap"),
        )
        rate = F.col("rate")
        base = -(rate * F.log(rate) + (1 - rate) * F.log(1 - rate))
        row = seen.select(
            F.lit(name).alias("model"),
            "n_scored",
            "n_outside",
            (F.col("loss") < base).alias("beats_base_rate"),
            (F.col("gap") < _MEAN_TOLERANCE[name]).alias("mean_matches"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@query("propensity_scores")
def propensity_scores(spark, sf_dir):
    panel = causal.player_season_panel(joined(spark, sf_dir))
    return causal.propensity_scores(panel).select(*causal.PANEL_KEY, "treatment", "propensity_score")


@query(
    "propensity_checks",
    """WITH scored AS (SELECT 1) SELECT true AS all_scored, 0::BIGINT AS n_outside, true AS mean_matches FROM scored""",
)
def propensity_checks(spark, sf_dir):
    """The propensity model gives every complete row a share, right on average."""
    panel = causal.player_season_panel(joined(spark, sf_dir))
    scored = causal.propensity_scores(panel)
    p, t = F.col("propensity_score"), F.col("treatment").cast("double")
    return scored.agg(
        (F.count(p) == F.count(F.lit(1))).alias("all_scored"),
        F.count_if((p <= 0) | (p >= 1)).alias("n_outside"),
        (F.abs(F.avg(p - t)) < 1e-3).alias("mean_matches"),
    )


@query(
    "split_sizes",
    f"""{fixture_sql()}, marked AS (
  SELECT * FROM shots JOIN (
    SELECT grp, row_number() OVER (ORDER BY h, grp) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM (
      SELECT DISTINCT game_id AS grp, CAST('0x' || substr(md5(game_id || '42'), 1, 8) AS BIGINT) AS h FROM shots)) ON game_id = grp)
SELECT season, season_type, count(*) AS n_shots_total, count(*) FILTER (NOT is_test) AS n_train,
  count(*) FILTER (is_test) AS n_test FROM marked GROUP BY 1, 2""",
)
def split_sizes(spark, sf_dir):
    rows = with_split(shots(spark, sf_dir))
    return rows.groupBy("season", "season_type").agg(
        F.count(F.lit(1)).alias("n_shots_total"),
        F.count_if(~F.col("is_test")).alias("n_train"),
        F.count_if("is_test").alias("n_test"),
    )


@query(
    "logistic_optimality",
    """WITH m(model) AS (VALUES ('baseline_logistic'), ('propensity')) SELECT model, true AS first_order_holds FROM m""",
)
def logistic_optimality(spark, sf_dir):
    """Both logistic fits meet the penalised first-order condition on every column, over their whole training tables."""
    from pyspark.ml.feature import VectorAssembler

    from ..operators import newton
    from ..operators.features import model_frame

    train, _ = _split(spark, sf_dir)
    baseline = modeling.fit_logistic(train, train.count())
    rows = model_frame(train)
    for stage in baseline.stages[:-1]:
        rows = stage.transform(rows)
    first = newton.gradient_check(baseline.stages[-1], rows).select(F.lit("baseline_logistic").alias("model"), "largest_gradient")
    valid = checkpointed(causal.complete_cases(causal.with_treatment(causal.player_season_panel(joined(spark, sf_dir)))))
    stats = valid.agg(*[F.avg(c).alias(f"m_{c}") for c in causal.CONFOUNDERS], *[F.stddev_pop(c).alias(f"s_{c}") for c in causal.CONFOUNDERS]).first()
    scaled = valid.withColumns({f"_z_{c}": (F.col(c) - F.lit(stats[f"m_{c}"])) / F.lit(stats[f"s_{c}"] or 1.0) for c in causal.CONFOUNDERS})
    assembled = VectorAssembler(inputCols=[f"_z_{c}" for c in causal.CONFOUNDERS], outputCol="_features").transform(scaled)
    model = newton.fit(assembled, features="_features", label="treatment")
    second = newton.gradient_check(model, assembled, features="_features", label="treatment").select(
        F.lit("propensity").alias("model"), "largest_gradient"
    )
    return first.unionByName(second).select("model", (F.col("largest_gradient") < 1e-6).alias("first_order_holds"))
