"""Does taking easier shots cause better scoring? Panel, weighting, DiD, sensitivity."""

from __future__ import annotations

import logging
import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import court
from ..functions.numeric import DISTANCE_UNIT, clip, exact_mean, exact_sum, mean_flag, mean_int, round_half_away, two_sided_p
from . import newton
from .bootstrap import replicate_sums, spread_of, with_spread
from .lineage import checkpointed
from .ranking import exact_quantiles, running_totals

logger = logging.getLogger(__name__)

PANEL_KEY = ["player_id", "player_name", "season", "season_type"]
# Confounders of the propensity model.
CONFOUNDERS = [
    "prior_actual_fg_pct",
    "prior_avg_xfg",
    "prior_shots_attempted",
    "three_pt_rate",
    "avg_shot_distance",
]
TREATED_QUANTILE = 0.667
SCORE_LIMITS = (0.05, 0.95)


def _career() -> WindowSpec:
    """A player's seasons of one type, in order."""
    return Window.partitionBy("player_id", "season_type").orderBy("season", "player_name")


def player_season_panel(scored: DataFrame, min_shots: int = 50) -> DataFrame:
    """One row per player, season and type, with the previous row's figures.

    "Previous" is the player's previous row that reached ``min_shots``.
    """
    made, prob = F.col("shot_made_flag"), F.col("p_make")
    panel = (
        scored.groupBy(*PANEL_KEY)
        .agg(
            F.count(F.lit(1)).alias("shots_attempted"),
            exact_mean(prob).alias("avg_xfg"),
            mean_int(made).alias("actual_fg_pct"),
            exact_mean(court.points(F.col("shot_type"), made)).alias("actual_pps"),
            exact_mean(court.points(F.col("shot_type"), prob)).alias("expected_pps"),
            mean_flag(court.is_three_by_type(F.col("shot_type"))).alias("three_pt_rate"),
            exact_mean(F.col("shot_distance"), DISTANCE_UNIT).alias("avg_shot_distance"),
        )
        .where(F.col("shots_attempted") >= min_shots)
        .withColumn("smoe", F.col("actual_fg_pct") - F.col("avg_xfg"))
    )
    lagged = {f"prior_{c}": F.lag(c, 1).over(_career()) for c in ("avg_xfg", "actual_fg_pct", "shots_attempted")}
    return panel.withColumns(lagged)


# -- inverse probability weighting -------------------------------------------


def with_treatment(panel: DataFrame, quantile: float = TREATED_QUANTILE) -> DataFrame:
    """Add treatment = 1 for rows at or above this quantile of avg_xfg over all rows."""
    panel = checkpointed(panel)
    threshold = exact_quantiles(panel, "avg_xfg", [quantile]).select(F.col("quantiles")[0].alias("t")).scalar()
    return panel.withColumn("treatment", (F.col("avg_xfg") >= threshold).cast("int"))


def complete_cases(panel: DataFrame) -> DataFrame:
    return panel.dropna(subset=[*CONFOUNDERS, "treatment"])


def propensity_scores(panel: DataFrame, max_iter: int = 100) -> DataFrame:
    """Complete rows with treatment and propensity_score from a logistic fit.

    Confounders are standardised with the population SD; the penalty is that
    of a unit ridge on the summed loss, solved by Newton steps (operators/newton.py).
    """
    valid = checkpointed(complete_cases(with_treatment(panel)))
    # ten numbers and a count
    fit = valid.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.avg(c).alias(f"m_{c}") for c in CONFOUNDERS],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in CONFOUNDERS],
    ).first()
    if fit["n"] < 20:
        logger.warning("only %d complete rows for the propensity model; results may be unstable", fit["n"])
    if fit["n"] == 0:
        return valid.withColumn("propensity_score", F.lit(None).cast("double"))
    scaled = valid.withColumns(
        {f"_z_{c}": (F.col(c) - F.lit(fit[f"m_{c}"])) / F.lit(fit[f"s_{c}"] or 1.0) for c in CONFOUNDERS}
    )
    assembled = VectorAssembler(inputCols=[f"_z_{c}" for c in CONFOUNDERS], outputCol="_features").transform(scaled)
    model = newton.fit(assembled, features="_features", label="treatment", l2=1.0, max_steps=max_iter, probability="_probability")
    scored = model.transform(assembled).withColumn("propensity_score", vector_to_array("_probability")[1])
    return scored.select(*valid.columns, "propensity_score")


def _weights(scored_panel: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    df = scored_panel.dropna(subset=["propensity_score", "treatment", "actual_pps"])
    df = df.withColumn("_ps", clip(F.col("propensity_score"), *SCORE_LIMITS))
    treated, control = F.col("treatment") == 1, F.col("treatment") == 0
    wt, wc = F.lit(1.0) / F.col("_ps"), F.lit(1.0) / (F.lit(1.0) - F.col("_ps"))
    y = F.col("actual_pps")
    return df, {
        "_wt": F.when(treated, wt),
        "_wty": F.when(treated, wt * y),
        "_wc": F.when(control, wc),
        "_wcy": F.when(control, wc * y),
    }


def _difference() -> Column:
    """Weighted treated mean minus weighted control mean; null when an arm is empty."""
    return F.try_divide(F.col("_wty"), F.col("_wt")) - F.try_divide(F.col("_wcy"), F.col("_wc"))


def ipw_point(scored_panel: DataFrame) -> DataFrame:
    """One row: average treatment effect by normalised inverse weights, and arm sizes."""
    df, measures = _weights(scored_panel)
    sums = df.agg(
        *[exact_sum(m).alias(name) for name, m in measures.items()],
        F.count_if(F.col("treatment") == 1).alias("n_treated"),
        F.count_if(F.col("treatment") == 0).alias("n_control"),
    )
    return sums.select(_difference().alias("ate"), "n_treated", "n_control")


def ipw_replicates(scored_panel: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    df, measures = _weights(scored_panel)
    sums = replicate_sums(df, PANEL_KEY, measures, replicates, seed)
    return sums.select("replicate", _difference().alias("ate"))


def ipw_effect(scored_panel: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    """One row: ate, n_treated, n_control, se, ci_lower, ci_upper, p_value."""
    scored_panel = checkpointed(scored_panel)
    spread = spread_of(ipw_replicates(scored_panel, replicates, seed), "ate")
    return with_spread(ipw_point(scored_panel), "ate", spread)


# -- difference in differences -----------------------------------------------


def did_groups(panel: DataFrame) -> DataFrame:
    """Rows with a previous season, marked treated or control by the change in avg_xfg.

    Treated rose by at least half a sample SD of all changes, control changed
    by less than that either way; those who fell by more are neither.
    """
    changes = panel.withColumn("delta_xfg", F.col("avg_xfg") - F.lag("avg_xfg", 1).over(_career()))
    rows = checkpointed(changes.dropna(subset=["delta_xfg", "actual_pps", "prior_actual_fg_pct"]))
    half_sd = rows.select((F.stddev_samp("delta_xfg") * F.lit(0.5)).alias("t")).scalar()
    return rows.withColumns(
        {
            "treated": F.coalesce((F.col("delta_xfg") >= half_sd).cast("int"), F.lit(0)),
            "control": F.coalesce((F.abs("delta_xfg") < half_sd).cast("int"), F.lit(0)),
        }
    )


def did_stack(groups: DataFrame) -> DataFrame:
    """Post rows (outcome of the season) over pre rows (outcome of the row before).

    The row before is sought among the rows that have a change, so a player's
    first such season has no pre row.
    """
    keep = [*PANEL_KEY, "treated", "control"]
    before = F.lag("actual_pps", 1).over(_career())
    pre = groups.select(*keep, F.lit(0).alias("period"), before.alias("outcome")).where(F.col("outcome").isNotNull())
    post = groups.select(*keep, F.lit(1).alias("period"), F.col("actual_pps").alias("outcome"))
    return pre.unionByName(post)


_CELLS = [("treated", 0, "treated_pre"), ("treated", 1, "treated_post"), ("control", 0, "control_pre"), ("control", 1, "control_post")]


def _cell_measures() -> dict[str, Column]:
    out = {}
    for arm, period, name in _CELLS:
        here = (F.col(arm) == 1) & (F.col("period") == period)
        out[f"n_{name}"] = F.when(here, F.lit(1.0))
        out[f"y_{name}"] = F.when(here, F.col("outcome"))
    return out


def _cell_means() -> list[Column]:
    return [F.try_divide(F.col(f"y_{name}"), F.col(f"n_{name}")).alias(name) for _, _, name in _CELLS]


def _did() -> Column:
    return (F.col("treated_post") - F.col("treated_pre")) - (F.col("control_post") - F.col("control_pre"))


def did_means(stack: DataFrame) -> DataFrame:
    """One row: the four cell means."""
    sums = stack.agg(*[exact_sum(m).alias(name) for name, m in _cell_measures().items()])
    return sums.select(*_cell_means())


def did_point(groups: DataFrame) -> DataFrame:
    """One row: did_estimate, the four means, and counts of treated and control rows."""
    means = did_means(did_stack(groups)).select(_did().alias("did_estimate"), "*")
    counts = groups.agg(
        F.count_if(F.col("treated") == 1).alias("t"), F.count_if(F.col("control") == 1).alias("c")
    ).select(F.struct("t", "c")).scalar()
    return means.withColumn("_c", counts).select(
        *means.columns, F.col("_c.t").alias("n_treated"), F.col("_c.c").alias("n_control")
    )


def did_replicates(groups: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    sums = replicate_sums(did_stack(groups), [*PANEL_KEY, "period"], _cell_measures(), replicates, seed)
    return sums.select("replicate", *_cell_means()).select("replicate", _did().alias("did_estimate"))


def difference_in_differences(panel: DataFrame, replicates: int = 500, seed: int = 42) -> DataFrame:
    """One row: did_estimate, cell means, counts, se, ci_lower, ci_upper, p_value, message.

    Without any row that has a previous season all figures are null.
    """
    groups = checkpointed(did_groups(panel))
    point = did_point(groups)
    spread = spread_of(did_replicates(groups, replicates, seed), "did_estimate", at_least=11)
    out = with_spread(point, "did_estimate", spread, flat_p=None)
    cells = [name for _, _, name in _CELLS]
    empty = F.coalesce(*cells).isNull()
    return out.withColumns({c: round_half_away(F.col(c), 4) for c in cells}).withColumn(
        "message", F.when(empty, "Insufficient panel data: at least two seasons per player are needed.")
    )


def parallel_trends(means: DataFrame) -> DataFrame:
    """Two rows (treated, control) with their pre and post outcome."""
    # The two group labels of the original's report, as it writes them.
    groups = F.array(
        F.struct(
            F.lit("Treated (improved selection)").alias("group"),
            F.col("treated_pre").alias("pre_outcome"),
            F.col("treated_post").alias("post_outcome"),
        ),
        F.struct(
            F.lit("Control (stable selection)").alias("group"),
            F.col("control_pre").alias("pre_outcome"),
            F.col("control_post").alias("post_outcome"),
        ),
    )
    return means.select(F.inline(groups))


# -- sensitivity to hidden bias ------------------------------------------------


def sensitivity_table(scored_panel: DataFrame, gamma_max: float = 3.0, gamma_step: float = 0.25) -> DataFrame:
    """(gamma, p_upper, significant): rank-sum test with treated outcomes shrunk by gamma.

    Average ranks come from counts per distinct value, so ties and large arms
    cost no sort of the rows. Fewer than five rows in an arm give no result.
    """
    steps = math.ceil((gamma_max + gamma_step - 1.0) / gamma_step - 1e-9)
    gammas = F.array(*[F.lit(1.0 + i * gamma_step) for i in range(steps)])
    df = scored_panel.dropna(subset=["treatment", "actual_pps", "propensity_score"]).select("treatment", "actual_pps")
    shrunk = df.select("treatment", "actual_pps", F.explode(gammas).alias("gamma")).select(
        "gamma",
        F.when(F.col("treatment") == 1, F.col("actual_pps") * (F.lit(1.0) / F.col("gamma")))
        .otherwise(F.col("actual_pps")).alias("outcome"),
        F.col("treatment"),
    )
    counted = checkpointed(
        shrunk.groupBy("gamma", "outcome").agg(
            F.count_if(F.col("treatment") == 1).alias("_t"), F.count(F.lit(1)).alias("_n")
        )
    )
    ranked = running_totals(counted, "outcome", ["_t", "_n"], by=["gamma"])
    average_rank = F.col("before__n") + (F.col("_n") + 1) / F.lit(2.0)
    arms = ranked.groupBy("gamma").agg(
        F.sum(F.col("_t") * average_rank).alias("rank_sum"),
        F.max("all__t").cast("double").alias("n1"),
        (F.max("all__n") - F.max("all__t")).cast("double").alias("n2"),
    ).where((F.col("n1") >= 5) & (F.col("n2") >= 5))
    n1, n2 = F.col("n1"), F.col("n2")
    expected = n1 * (n1 + n2 + 1) / 2.0
    z = (F.col("rank_sum") - expected) / F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    p = two_sided_p(z)
    return arms.select("gamma", round_half_away(p, 4).alias("p_upper"), (p < 0.05).alias("significant"))


def sensitivity_summary(table: DataFrame, gamma_max: float = 3.0) -> DataFrame:
    """One row: gamma_break (first gamma without significance) and a sentence."""
    row = table.agg(F.min(F.when(~F.col("significant"), F.col("gamma"))).alias("gamma_break"), F.count(F.lit(1)).alias("_n"))
    top = F.lit(float(gamma_max))
    lost = F.format_string(
        "The effect stops being significant at gamma = %.2f: a hidden factor would have to make "
        "treatment %.2f times as likely to explain it.",
        "gamma_break",
        "gamma_break",
    )
    held = F.format_string("The effect stays significant up to gamma = %.2f.", top)
    text = (
        F.when(F.col("_n") == 0, "Too few rows for a sensitivity analysis.")
        .when(F.col("gamma_break").isNotNull(), lost)
        .otherwise(held)
    )
    return row.select("gamma_break", text.alias("interpretation"))
