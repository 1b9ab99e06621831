"""Reports over shots joined with their predictions.

Every report takes scored shots: the rows of ``join_predictions``. Thresholds
are keyword arguments; figures are rounded the way the reports are read unless
``round_output`` is off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import court
from ..functions.numeric import DISTANCE_UNIT, exact_mean, mean_flag, mean_int, round_half_away, rounded
from ..functions.seasons import month_key
from .ranking import scored_positions

PLAYER_SEASON = ["player_id", "player_name", "season", "season_type"]
LEADERBOARD_METRICS = ["attempts", "fg_pct", "xfg_pct", "smoe", "shot_diet_difficulty"]
# Headings of the displayed leaderboard.
LEADERBOARD_HEADINGS = {
    "player_name": "Player",
    "attempts": "Attempts",
    "fg_pct": "FG%",
    "xfg_pct": "xFG%",
    "smoe": "SMOE",
    "shot_diet_difficulty": "Shot Diet Difficulty",
}


def join_predictions(shots: DataFrame, predictions: DataFrame, outcome: bool = False) -> DataFrame:
    """Shots that have a prediction, with it as ``p_make``.

    ``outcome`` adds what was stored with the prediction as ``actual_make``, so
    that a shot corrected later does not change past calibration.

    Both sides are unique on shot_id, so the join neither multiplies rows nor
    skews. Both are stored by season and type, which are part of the key, so a
    season's filter on the result prunes both scans.
    """
    key = ["season", "season_type", "shot_id"]
    added = ["p_make", *(["actual_make"] if outcome else [])]
    scores = predictions.withColumnRenamed("predicted_make_prob", "p_make").select(*key, *added)
    return shots.join(scores, key, "inner").select(*shots.columns, *added)


def _made():
    return mean_int(F.col("shot_made_flag"))


def _expected():
    return exact_mean(F.col("p_make"))


def _feet():
    return exact_mean(F.col("shot_distance"), DISTANCE_UNIT)


def player_months(scored: DataFrame) -> DataFrame:
    """One row per player, season, type and month."""
    dated = scored.where(F.col("game_date").isNotNull()).withColumn("month", month_key(F.col("game_date")))
    return dated.groupBy(*PLAYER_SEASON, "month").agg(
        _expected().alias("avg_xfg"),
        _made().alias("actual_fg"),
        F.count(F.lit(1)).alias("shots_attempted"),
        mean_flag(court.is_three_by_zone(F.col("shot_zone_basic"))).alias("three_pt_rate"),
        _feet().alias("avg_shot_distance"),
    )


def monthly_trends(scored: DataFrame, min_shots: int = 20, round_output: bool = True) -> DataFrame:
    """Month-over-month shot quality per player.

    Small months are dropped only after the windows, so they still count as a
    "previous month" and in the rolling mean.
    """
    w = Window.partitionBy("player_id", "season", "season_type").orderBy("month", "player_name")
    prev = F.lag("avg_xfg", 1).over(w)
    prev_fg = F.lag("actual_fg", 1).over(w)
    trends = player_months(scored).select(
        "*",
        prev.alias("prev_month_xfg_pct"),
        (F.col("avg_xfg") - prev).alias("xfg_delta"),
        F.avg("avg_xfg").over(w.rowsBetween(-2, 0)).alias("rolling_3mo_avg_xfg"),
        prev_fg.alias("prev_month_fg_pct"),
        (F.col("actual_fg") - prev_fg).alias("fg_delta"),
    )
    out = trends.where(F.col("shots_attempted") >= min_shots).select(
        *PLAYER_SEASON,
        "month",
        F.col("avg_xfg").alias("avg_xfg_pct"),
        F.col("actual_fg").alias("actual_fg_pct"),
        (F.col("actual_fg") - F.col("avg_xfg")).alias("smoe"),
        "prev_month_xfg_pct",
        "xfg_delta",
        "rolling_3mo_avg_xfg",
        "prev_month_fg_pct",
        "fg_delta",
        "three_pt_rate",
        "avg_shot_distance",
        "shots_attempted",
    )
    if round_output:
        four = ["avg_xfg_pct", "actual_fg_pct", "smoe", "prev_month_xfg_pct", "xfg_delta"]
        four += ["rolling_3mo_avg_xfg", "three_pt_rate"]
        out = rounded(out, {**dict.fromkeys(four, 4), "avg_shot_distance": 2})
        out = out.drop("prev_month_fg_pct", "fg_delta")
    return out


def context_cohorts(scored: DataFrame, min_attempts: int = 30, round_output: bool = True) -> DataFrame:
    """Distance x angle x zone cohorts, ranked by SMOE among those large enough.

    The windows run on cohorts (16 per zone name), never on shots.
    """
    cohorts = (
        scored.groupBy(
            court.distance_cohort(F.col("shot_distance")).alias("distance_cohort"),
            court.angle_cohort(F.col("shot_zone_area")).alias("angle_cohort"),
            F.col("shot_zone_basic").alias("shot_zone"),
        )
        .agg(F.count(F.lit(1)).alias("attempts"), _made().alias("actual_fg_pct"), _expected().alias("avg_xfg_pct"))
        .where(F.col("attempts") >= min_attempts)
        .withColumn("smoe", F.col("actual_fg_pct") - F.col("avg_xfg_pct"))
    )
    by_zone = Window.partitionBy("shot_zone").orderBy(F.col("smoe").desc())
    overall = Window.partitionBy(F.lit(0)).orderBy(
        F.col("smoe").desc(), "shot_zone", "distance_cohort", "angle_cohort"
    )
    out = cohorts.select(
        "*",
        F.rank().over(by_zone).alias("smoe_rank_within_zone"),
        F.ntile(4).over(overall).alias("smoe_quartile"),
    )
    return rounded(out, {"actual_fg_pct": 4, "avg_xfg_pct": 4, "smoe": 4}) if round_output else out


def overperformers(scored: DataFrame, min_shots: int = 100, z: float = 1.96) -> DataFrame:
    """Player-seasons whose 95% lower bound of SMOE is above zero.

    Filter, quintile and rank work on SMOE rounded to 4 digits and the
    half-width rounded to 6.
    """
    miss = F.col("shot_made_flag") - F.col("p_make")
    stats = scored.groupBy(*PLAYER_SEASON).agg(
        F.count(F.lit(1)).alias("total_shots"),
        _expected().alias("_xfg"),
        _made().alias("_fg"),
        exact_mean(miss).alias("_m1"),
        exact_mean(miss * miss).alias("_m2"),
    )
    spread = F.sqrt(F.greatest(F.col("_m2") - F.col("_m1") * F.col("_m1"), F.lit(0.0)))
    players = stats.where(F.col("total_shots") >= min_shots).select(
        *PLAYER_SEASON,
        "total_shots",
        round_half_away(F.col("_xfg"), 4).alias("avg_xfg"),
        round_half_away(F.col("_fg"), 4).alias("avg_actual_fg"),
        round_half_away(F.col("_fg") - F.col("_xfg"), 4).alias("smoe"),
        round_half_away(spread, 6).alias("smoe_std"),
        round_half_away(F.lit(z) * spread / F.sqrt(F.col("total_shots").cast("double")), 6).alias("smoe_ci_halfwidth"),
    )
    kept = players.where(F.col("smoe") - F.col("smoe_ci_halfwidth") > 0)
    placed = scored_positions(kept, "smoe", "player_id", PLAYER_SEASON, tiles=5)
    return placed.select(
        *kept.columns,
        round_half_away(F.col("smoe") - F.col("smoe_ci_halfwidth"), 4).alias("smoe_ci_lower"),
        round_half_away(F.col("smoe") + F.col("smoe_ci_halfwidth"), 4).alias("smoe_ci_upper"),
        F.col("tile").alias("smoe_quintile"),
        F.col("position_rank").alias("smoe_rank"),
    )


def zone_seasons(scored: DataFrame, min_shots: int = 50, round_output: bool = True) -> DataFrame:
    """Selection and efficiency per season, type and zone."""
    zones = (
        scored.groupBy("season", "season_type", F.col("shot_zone_basic").alias("shot_zone"))
        .agg(
            F.count(F.lit(1)).alias("total_shots"),
            _expected().alias("avg_xfg"),
            _made().alias("actual_fg_pct"),
            _feet().alias("avg_distance"),
            mean_flag(court.is_three_by_type(F.col("shot_type"))).alias("three_pt_rate"),
            mean_flag(court.is_paint(F.col("shot_zone_basic"))).alias("paint_rate"),
        )
        .where(F.col("total_shots") >= min_shots)
        .withColumn("smoe", F.col("actual_fg_pct") - F.col("avg_xfg"))
    )
    over_seasons = Window.partitionBy("shot_zone", "season_type").orderBy("season").rowsBetween(-1, 0)
    in_season = Window.partitionBy("season", "season_type").orderBy(F.col("smoe").desc())
    out = zones.select(
        "season",
        "season_type",
        "shot_zone",
        "total_shots",
        "avg_xfg",
        "actual_fg_pct",
        "smoe",
        "avg_distance",
        "three_pt_rate",
        "paint_rate",
        F.avg("avg_xfg").over(over_seasons).alias("rolling_2season_xfg"),
        F.rank().over(in_season).alias("smoe_rank_in_season"),
    )
    if round_output:
        four = dict.fromkeys(["avg_xfg", "actual_fg_pct", "smoe", "rolling_2season_xfg"], 4)
        out = rounded(out, {**four, "avg_distance": 2})
    return out


# How each report is sorted when shown; kept apart so that a writer can skip it.
REPORT_ORDER = {
    "monthly_trends": ["player_name", "season", "month"],
    "context_cohorts": ["shot_zone", "smoe_rank_within_zone"],
    "overperformers": ["smoe_rank"],
    "zone_seasons": [("season", "desc"), ("total_shots", "desc")],
}


def in_report_order(report: DataFrame, name: str) -> DataFrame:
    keys = [F.col(k) if isinstance(k, str) else getattr(F.col(k[0]), k[1])() for k in REPORT_ORDER[name]]
    return report.orderBy(*keys)


def player_metrics(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per player: attempts (all rows), FG, expected FG, SMOE and difficulty, x100.

    Unscored shots count as attempts but not in the expected mean.
    """
    hundred = F.lit(100.0)
    flag = F.coalesce(F.col("shot_made_flag").try_cast("int"), F.lit(0))
    groups = scored.groupBy(*(by or []), "player_id", "player_name").agg(
        F.count(F.lit(1)).alias("attempts"), mean_int(flag).alias("_fg"), _expected().alias("_xfg")
    )
    return groups.select(
        *(by or []),
        "player_id",
        "player_name",
        "attempts",
        (F.col("_fg") * hundred).alias("fg_pct"),
        (F.col("_xfg") * hundred).alias("xfg_pct"),
        ((F.col("_fg") - F.col("_xfg")) * hundred).alias("smoe"),
        ((F.lit(1.0) - F.col("_xfg")) * hundred).alias("shot_diet_difficulty"),
    )


def leaderboard(
    metrics: DataFrame,
    sort_by: str = "attempts",
    ascending: bool = False,
    min_attempts: int = 100,
    top_n: int = 25,
    headings: bool = False,
) -> DataFrame:
    """The first players by one of five metrics, rounded to one digit."""
    if sort_by not in LEADERBOARD_METRICS:
        raise ValueError(f"sort_by must be one of {LEADERBOARD_METRICS}")
    key = F.col(sort_by).asc_nulls_last() if ascending else F.col(sort_by).desc_nulls_last()
    top = metrics.where(F.col("attempts") >= min_attempts).orderBy(key, "player_id", "player_name").limit(top_n)
    top = rounded(top, dict.fromkeys(LEADERBOARD_METRICS[1:], 1))
    if headings:
        top = top.select([F.col(c).alias(h) for c, h in LEADERBOARD_HEADINGS.items()])
    return top


def kpis(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Attempts, FG, expected FG, SMOE, difficulty; the last three null if unscored."""
    figures = scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("attempts"), _made().alias("fg_pct"), _expected().alias("xfg_pct")
    )
    return figures.select(
        "*",
        (F.col("fg_pct") - F.col("xfg_pct")).alias("smoe"),
        (F.lit(1.0) - F.col("xfg_pct")).alias("shot_diet_difficulty"),
    )
