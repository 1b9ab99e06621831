"""Reports R1-R5, leaderboard and KPIs."""

from __future__ import annotations

from ..functions.numeric import rounded
from ..operators import reports
from ..plans.sql_reports import register_views, run_sql
from ..sources.star_schema import predictions, shots
from .base import FEET, FG, PAINT, THREE_TYPE, THREE_ZONE, XFG, fixture_sql, joined, query, rounded_sql, scored, share_sql

R4 = rounded_sql

_MONTHS = f"""
{fixture_sql()}, months AS (
  SELECT player_id, player_name, season, season_type, strftime(game_date, '%Y-%m') AS month,
    {XFG} AS avg_xfg, {FG} AS actual_fg, count(*) AS shots_attempted,
    {share_sql(THREE_ZONE)} AS three_pt_rate, {FEET} AS avg_shot_distance
  FROM scored GROUP BY ALL)"""


@query("player_months", f"{_MONTHS} SELECT * FROM months")
def player_months(spark, sf_dir):
    return reports.player_months(joined(spark, sf_dir))


@query(
    "monthly_trends",
    f"""{_MONTHS}, trends AS (
  SELECT *, lag(avg_xfg, 1) OVER w AS p1, lag(avg_xfg, 2) OVER w AS p2
  FROM months WINDOW w AS (PARTITION BY player_id, season, season_type ORDER BY month))
SELECT player_id, player_name, season, season_type, month,
  {R4('avg_xfg', 4)} AS avg_xfg_pct, {R4('actual_fg', 4)} AS actual_fg_pct,
  {R4('(actual_fg - avg_xfg)', 4)} AS smoe, {R4('p1', 4)} AS prev_month_xfg_pct,
  {R4('(avg_xfg - p1)', 4)} AS xfg_delta,
  {R4('''(CASE WHEN p1 IS NULL THEN avg_xfg WHEN p2 IS NULL THEN (p1 + avg_xfg) / 2
         ELSE (p2 + p1 + avg_xfg) / 3 END)''', 4)} AS rolling_3mo_avg_xfg,
  {R4('three_pt_rate', 4)} AS three_pt_rate, {R4('avg_shot_distance', 2)} AS avg_shot_distance,
  shots_attempted
FROM trends WHERE shots_attempted >= 20""",
)
def monthly_trends(spark, sf_dir):
    return reports.in_report_order(reports.monthly_trends(joined(spark, sf_dir)), "monthly_trends")


@query(
    "monthly_fg_changes",
    f"""{_MONTHS}, trends AS (
  SELECT *, lag(actual_fg, 1) OVER w AS q1 FROM months
  WINDOW w AS (PARTITION BY player_id, season, season_type ORDER BY month))
SELECT player_id, season, season_type, month, {R4('q1', 4)} AS prev_month_fg_pct,
  {R4('(actual_fg - q1)', 4)} AS fg_delta FROM trends WHERE shots_attempted >= 20""",
)
def monthly_fg_changes(spark, sf_dir):
    """The field-goal half of the trends, which the displayed report leaves out."""
    trends = reports.monthly_trends(joined(spark, sf_dir), round_output=False)
    found = trends.select("player_id", "season", "season_type", "month", "prev_month_fg_pct", "fg_delta")
    return rounded(found, {"prev_month_fg_pct": 4, "fg_delta": 4})


@query(
    "context_cohorts",
    f"""{fixture_sql()}, cohorts AS (
  SELECT CASE WHEN shot_distance <= 5 THEN 'at_rim' WHEN shot_distance <= 10 THEN 'short_mid'
              WHEN shot_distance <= 18 THEN 'mid_range' ELSE 'long_range' END AS distance_cohort,
    CASE WHEN shot_zone_area = 'Center(C)' THEN 'straight_on' WHEN shot_zone_area ILIKE '%left%' THEN 'left_side'
         WHEN shot_zone_area ILIKE '%right%' THEN 'right_side' ELSE 'other' END AS angle_cohort,
    shot_zone_basic AS shot_zone, count(*) AS attempts, {FG} AS fg, {XFG} AS xfg
  FROM scored GROUP BY 1, 2, 3 HAVING count(*) >= 30)
SELECT distance_cohort, angle_cohort, shot_zone, attempts, {R4('fg', 4)} AS actual_fg_pct,
  {R4('xfg', 4)} AS avg_xfg_pct, {R4('(fg - xfg)', 4)} AS smoe,
  CAST(rank() OVER (PARTITION BY shot_zone ORDER BY fg - xfg DESC) AS INTEGER) AS smoe_rank_within_zone,
  CAST(ntile(4) OVER (ORDER BY fg - xfg DESC, shot_zone, distance_cohort, angle_cohort) AS INTEGER) AS smoe_quartile
FROM cohorts""",
)
def context_cohorts(spark, sf_dir):
    return reports.in_report_order(reports.context_cohorts(joined(spark, sf_dir)), "context_cohorts")


def _overperformers_sql(players: str, min_shots: int) -> str:
    var = "greatest(m2 - m1 * m1, 0)"
    half = f"(1.96 * sqrt({var}) / sqrt(CAST(total_shots AS DOUBLE)))"
    return f"""{fixture_sql(players)}, stats AS (
  SELECT player_id, player_name, season, season_type, count(*) AS total_shots, {XFG} AS xfg, {FG} AS fg,
    CAST(sum(10000 * shot_made_flag - p4) AS DOUBLE) / (count(*) * 10000) AS m1,
    CAST(sum((10000 * shot_made_flag - p4) * (10000 * shot_made_flag - p4)) AS DOUBLE)
      / (count(*) * 100000000) AS m2
  FROM scored GROUP BY 1, 2, 3, 4 HAVING count(*) >= {min_shots}
), players AS (
  SELECT player_id, player_name, season, season_type, total_shots, {R4('xfg', 4)} AS avg_xfg,
    {R4('fg', 4)} AS avg_actual_fg, {R4('(fg - xfg)', 4)} AS smoe, {R4(f'sqrt({var})', 6)} AS smoe_std,
    {R4(half, 6)} AS smoe_ci_halfwidth
  FROM stats)
SELECT *, {R4('(smoe - smoe_ci_halfwidth)', 4)} AS smoe_ci_lower,
  {R4('(smoe + smoe_ci_halfwidth)', 4)} AS smoe_ci_upper,
  CAST(ntile(5) OVER (ORDER BY smoe DESC, player_id % 64, player_id, player_name, season, season_type)
    AS INTEGER) AS smoe_quintile,
  rank() OVER (ORDER BY smoe DESC) AS smoe_rank
FROM players WHERE smoe - smoe_ci_halfwidth > 0"""


@query("overperformers", _overperformers_sql("nation", 100))
def overperformers(spark, sf_dir):
    return reports.in_report_order(reports.overperformers(joined(spark, sf_dir)), "overperformers")


@query("overperformers_many_players", _overperformers_sql("supplier", 20))
def overperformers_many_players(spark, sf_dir):
    found = reports.overperformers(joined(spark, sf_dir, "supplier"), min_shots=20)
    return reports.in_report_order(found, "overperformers")


_ZONE_SEASONS = f"""{fixture_sql()}, zones AS (
  SELECT season, season_type, shot_zone_basic AS shot_zone, count(*) AS total_shots, {XFG} AS xfg, {FG} AS fg,
    {FEET} AS dist, {share_sql(THREE_TYPE)} AS three_pt_rate, {share_sql(PAINT)} AS paint_rate
  FROM scored GROUP BY 1, 2, 3 HAVING count(*) >= 50
), rolled AS (
  SELECT *, lag(xfg) OVER (PARTITION BY shot_zone, season_type ORDER BY season) AS before FROM zones)
SELECT season, season_type, shot_zone, total_shots, {R4('xfg', 4)} AS avg_xfg, {R4('fg', 4)} AS actual_fg_pct,
  {R4('(fg - xfg)', 4)} AS smoe, {R4('dist', 2)} AS avg_distance, three_pt_rate, paint_rate,
  {R4('(CASE WHEN before IS NULL THEN xfg ELSE (before + xfg) / 2 END)', 4)} AS rolling_2season_xfg,
  CAST(rank() OVER (PARTITION BY season, season_type ORDER BY fg - xfg DESC) AS INTEGER) AS smoe_rank_in_season
FROM rolled"""


@query("zone_season", _ZONE_SEASONS)
def zone_season(spark, sf_dir):
    return reports.in_report_order(reports.zone_seasons(joined(spark, sf_dir)), "zone_seasons")


# Report SQL as a user would save it, with a bound threshold.
SAVED_ZONE_SQL = """
SELECT s.season, s.season_type, s.shot_zone_basic AS shot_zone, count(*) AS total_shots,
  sum(s.shot_made_flag) AS made,
  sum(CASE WHEN s.shot_type = '3PT Field Goal' THEN 1 ELSE 0 END) AS threes,
  rank() OVER (PARTITION BY s.season, s.season_type ORDER BY count(*) DESC, s.shot_zone_basic) AS volume_rank
FROM shots s JOIN predictions p ON p.shot_id = s.shot_id
GROUP BY s.season, s.season_type, s.shot_zone_basic
HAVING count(*) >= :min_shots
"""


@query(
    "saved_sql_report",
    f"""{fixture_sql()}
SELECT season, season_type, shot_zone_basic AS shot_zone, count(*) AS total_shots,
  CAST(sum(shot_made_flag) AS BIGINT) AS made,
  CAST(sum(CASE WHEN {THREE_TYPE} THEN 1 ELSE 0 END) AS BIGINT) AS threes,
  CAST(rank() OVER (PARTITION BY season, season_type ORDER BY count(*) DESC, shot_zone_basic) AS INTEGER) AS volume_rank
FROM scored GROUP BY 1, 2, 3 HAVING count(*) >= 50""",
)
def saved_sql_report(spark, sf_dir):
    register_views(shots(spark, sf_dir), predictions(spark, sf_dir))
    return run_sql(spark, SAVED_ZONE_SQL, {"min_shots": 50})


def _metrics_sql(players: str, keys: str) -> str:
    return f"""{fixture_sql(players)}, figures AS (
  SELECT {keys}, count(*) AS attempts, {FG} AS fg, {XFG} AS xfg FROM scored GROUP BY ALL)
"""


@query(
    "player_metrics",
    f"""{_metrics_sql('supplier', 'season, season_type, player_id, player_name')}
SELECT season, season_type, player_id, player_name, attempts, fg * 100 AS fg_pct, xfg * 100 AS xfg_pct,
  (fg - xfg) * 100 AS smoe, (1 - xfg) * 100 AS shot_diet_difficulty FROM figures""",
)
def player_metrics(spark, sf_dir):
    return reports.player_metrics(scored(spark, sf_dir, "supplier"), by=["season", "season_type"])


@query(
    "leaderboard",
    f"""{_metrics_sql('supplier', 'player_id, player_name')}
SELECT player_id, player_name, attempts, {R4('(fg * 100)', 1)} AS fg_pct, {R4('(xfg * 100)', 1)} AS xfg_pct,
  {R4('((fg - xfg) * 100)', 1)} AS smoe, {R4('((1 - xfg) * 100)', 1)} AS shot_diet_difficulty
FROM figures WHERE attempts >= 100 ORDER BY (fg - xfg) * 100 DESC, player_id, player_name LIMIT 25""",
)
def leaderboard(spark, sf_dir):
    return reports.leaderboard(reports.player_metrics(scored(spark, sf_dir, "supplier")), sort_by="smoe")


@query(
    "player_kpis",
    f"""{_metrics_sql('nation', 'player_id, season, season_type')}
SELECT player_id, season, season_type, attempts, fg AS fg_pct, xfg AS xfg_pct, fg - xfg AS smoe,
  1 - xfg AS shot_diet_difficulty FROM figures""",
)
def player_kpis(spark, sf_dir):
    return reports.kpis(scored(spark, sf_dir), by=["player_id", "season", "season_type"])


@query(
    "league_kpis",
    f"""{fixture_sql()} SELECT count(*) AS attempts, {FG} AS fg_pct, {XFG} AS xfg_pct, {FG} - {XFG} AS smoe,
  1 - {XFG} AS shot_diet_difficulty FROM scored""",
)
def league_kpis(spark, sf_dir):
    return reports.kpis(scored(spark, sf_dir))


