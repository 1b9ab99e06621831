"""Panel, treatment, weighting, difference in differences, sensitivity, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import ERF_A, ERF_P, rounded
from ..operators import causal
from ..operators.bootstrap import POISSON_STEPS, spread_of
from .base import FEET, FG, THREE_TYPE, XFG, fixture_sql, joined, query, rounded_sql, share_sql, units_sql
from .monitoring import quantile_sql

_POINTS = f"CASE WHEN {THREE_TYPE} THEN 3 ELSE 2 END"
_KEY = "player_id, player_name, season, season_type"


def _panel_sql(players: str = "nation", min_shots: int = 50) -> str:
    return f"""{fixture_sql(players)}, seasons AS (
  SELECT {_KEY}, count(*) AS shots_attempted, {XFG} AS avg_xfg, {FG} AS actual_fg_pct,
    CAST(sum({_POINTS} * shot_made_flag) AS DOUBLE) / count(*) AS actual_pps,
    CAST(sum({_POINTS} * p4) AS DOUBLE) / (count(*) * 10000) AS expected_pps, {FG} - {XFG} AS smoe,
    {share_sql(THREE_TYPE)} AS three_pt_rate, {FEET} AS avg_shot_distance
  FROM scored GROUP BY 1, 2, 3, 4 HAVING count(*) >= {min_shots}
), panel AS (
  SELECT *, lag(avg_xfg) OVER w AS prior_avg_xfg, lag(actual_fg_pct) OVER w AS prior_actual_fg_pct,
    lag(shots_attempted) OVER w AS prior_shots_attempted
  FROM seasons WINDOW w AS (PARTITION BY player_id, season_type ORDER BY season, player_name))"""


def _panel(spark, sf_dir, players="nation", min_shots=50):
    return causal.player_season_panel(joined(spark, sf_dir, players), min_shots)


@query("player_season_panel", f"{_panel_sql()} SELECT * FROM panel")
def player_season_panel(spark, sf_dir):
    return _panel(spark, sf_dir)


@query("player_season_panel_many_players", f"{_panel_sql('supplier', 20)} SELECT * FROM panel")
def player_season_panel_many_players(spark, sf_dir):
    return _panel(spark, sf_dir, "supplier", 20)


# A stand-in score from the panel's own figures, so that SQL can repeat it.
_SCORED = f"""{_panel_sql()}, cut AS (
  SELECT {quantile_sql('vs', '0.667::DOUBLE')} AS t FROM (SELECT list_sort(list(avg_xfg)) AS vs FROM panel)
), treated AS (SELECT *, CASE WHEN avg_xfg >= t THEN 1 ELSE 0 END AS treatment FROM panel, cut),
weighted AS (
  SELECT *, 0.02::DOUBLE + 0.96::DOUBLE * (CAST(shots_attempted % 97 AS DOUBLE) / 96) AS propensity_score
  FROM treated WHERE prior_actual_fg_pct IS NOT NULL
), arms AS (
  SELECT *, greatest(least(propensity_score, 0.95::DOUBLE), 0.05::DOUBLE) AS ps FROM weighted
), sums AS (
  SELECT *, CASE WHEN treatment = 1 THEN {units_sql('1 / ps')} END AS wt,
    CASE WHEN treatment = 1 THEN {units_sql('1 / ps * actual_pps')} END AS wty,
    CASE WHEN treatment = 0 THEN {units_sql('1 / (1 - ps)')} END AS wc,
    CASE WHEN treatment = 0 THEN {units_sql('1 / (1 - ps) * actual_pps')} END AS wcy FROM arms)"""


def _weighted(spark, sf_dir):
    panel = causal.complete_cases(causal.with_treatment(_panel(spark, sf_dir)))
    share = (F.col("shots_attempted") % 97).cast("double") / F.lit(96.0)
    return panel.withColumn("propensity_score", F.lit(0.02) + F.lit(0.96) * share)


@query("treatment_flag", f"{_SCORED} SELECT {_KEY}, avg_xfg, treatment FROM treated")
def treatment_flag(spark, sf_dir):
    return causal.with_treatment(_panel(spark, sf_dir)).select(*causal.PANEL_KEY, "avg_xfg", "treatment")


def _ratio(a: str, b: str) -> str:
    return f"CAST(sum({a}) AS DOUBLE) / CAST(sum({b}) AS DOUBLE)"


_ATE = f"{_ratio('wty', 'wt')} - {_ratio('wcy', 'wc')}"
_POINT = f"""point AS (SELECT {_ATE} AS ate, count(*) FILTER (treatment = 1) AS n_treated,
  count(*) FILTER (treatment = 0) AS n_control FROM sums)"""


@query("ipw_ate", f"{_SCORED}, {_POINT} SELECT * FROM point")
def ipw_ate(spark, sf_dir):
    return causal.ipw_point(_weighted(spark, sf_dir))


def _copies_sql(source: str, key: str, replicates: int = 500) -> str:
    """CTE copies: rows times replicates with their hashed Poisson count."""
    count = " + ".join(f"CASE WHEN u >= {s!r}::DOUBLE THEN 1 ELSE 0 END" for s in POISSON_STEPS)
    return f"""draws AS (
  SELECT s.*, b.block, j.j, md5({key} || '|' || b.block || '|42') AS digest
  FROM {source} s, (SELECT unnest(range({-(-replicates // 4)})) AS block) b, (SELECT unnest(range(4)) AS j) j
), uniform AS (
  SELECT *, block * 4 + j AS replicate,
    (CAST(CAST('0x' || substr(digest, 1 + 8 * j, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE AS u FROM draws
), copies AS (SELECT *, {count} AS k FROM uniform)"""


_ROW_KEY = "player_id || '|' || player_name || '|' || season || '|' || season_type"


def _weighted_ratio(a: str, b: str) -> str:
    return f"(CAST(sum({a} * k) AS DOUBLE) / 1e9) / nullif(CAST(sum({b} * k) AS DOUBLE) / 1e9, 0)"


_IPW_REPS = f"""{_copies_sql('sums', _ROW_KEY)}, reps AS (
  SELECT replicate, {_weighted_ratio('wty', 'wt')} - {_weighted_ratio('wcy', 'wc')} AS ate FROM copies GROUP BY 1)"""


@query("bootstrap_replicates", f"{_SCORED}, {_IPW_REPS} SELECT CAST(replicate AS INTEGER) AS replicate, ate FROM reps")
def bootstrap_replicates(spark, sf_dir):
    return causal.ipw_replicates(_weighted(spark, sf_dir))


def _spread_sql(column: str, source: str = "reps") -> str:
    return f"""spread AS (SELECT stddev_pop({column}) AS se, quantile_cont({column}, 0.025) AS lo,
  quantile_cont({column}, 0.975) AS hi FROM {source} WHERE {column} IS NOT NULL)"""


@query(
    "bootstrap_ci",
    f"""{_SCORED}, {_IPW_REPS}, {_spread_sql('ate')}
SELECT {rounded_sql('se', 9)} AS se, {rounded_sql('lo', 9)} AS ci_lower, {rounded_sql('hi', 9)} AS ci_upper FROM spread""",
)
def bootstrap_ci(spark, sf_dir):
    spread = spread_of(causal.ipw_replicates(_weighted(spark, sf_dir)), "ate")
    return rounded(spread, {"se": 9, "ci_lower": 9, "ci_upper": 9})


def p_value_sql(z: str) -> str:
    x = f"(abs({z}) / sqrt(2.0::DOUBLE))"
    t = f"(1.0 / (1.0 + {ERF_P!r}::DOUBLE * {x}))"
    series = "0.0::DOUBLE"
    for a in reversed(ERF_A):
        series = f"(({series}) + {a!r}::DOUBLE) * {t}"
    return f"({series} * exp(-{x} * {x}))"


@query(
    "ipw_effect",
    f"""{_SCORED}, {_POINT}, {_IPW_REPS}, {_spread_sql('ate')}
SELECT {rounded_sql('ate', 5)} AS ate, n_treated, n_control, {rounded_sql('se', 5)} AS se,
  {rounded_sql('lo', 5)} AS ci_lower, {rounded_sql('hi', 5)} AS ci_upper,
  {rounded_sql(p_value_sql('(ate / se)'), 4)} AS p_value FROM point, spread""",
)
def ipw_effect(spark, sf_dir):
    return causal.ipw_effect(_weighted(spark, sf_dir))


# -- difference in differences -------------------------------------------------

_DID = f"""{_panel_sql()}, changes AS (
  SELECT *, avg_xfg - lag(avg_xfg) OVER (PARTITION BY player_id, season_type ORDER BY season, player_name) AS delta_xfg
  FROM panel
), kept AS (SELECT * FROM changes WHERE delta_xfg IS NOT NULL),
half AS (SELECT stddev_samp(delta_xfg) * 0.5 AS h FROM kept),
grouped AS (
  SELECT {_KEY}, actual_pps, delta_xfg, CASE WHEN delta_xfg >= h THEN 1 ELSE 0 END AS treated,
    CASE WHEN abs(delta_xfg) < h THEN 1 ELSE 0 END AS control FROM kept, half
), lagged AS (
  SELECT *, lag(actual_pps) OVER (PARTITION BY player_id, season_type ORDER BY season, player_name) AS before FROM grouped
), stack AS (
  SELECT {_KEY}, treated, control, 0 AS period, before AS outcome FROM lagged WHERE before IS NOT NULL
  UNION ALL SELECT {_KEY}, treated, control, 1, actual_pps FROM grouped
)"""
_CELLS = {
    "treated_pre": "treated = 1 AND period = 0",
    "treated_post": "treated = 1 AND period = 1",
    "control_pre": "control = 1 AND period = 0",
    "control_post": "control = 1 AND period = 1",
}
_Y = units_sql("outcome")
_MEANS = "means AS (SELECT " + ", ".join(
    f"CAST(sum({_Y}) FILTER ({c}) AS DOUBLE) / (count(*) FILTER ({c}) * 1e9) AS {name}" for name, c in _CELLS.items()
) + " FROM stack)"
_DELTA = "(treated_post - treated_pre) - (control_post - control_pre)"


@query("did_groups", f"{_DID} SELECT {_KEY}, delta_xfg, treated, control FROM grouped")
def did_groups(spark, sf_dir):
    return causal.did_groups(_panel(spark, sf_dir)).select(*causal.PANEL_KEY, "delta_xfg", "treated", "control")


@query(
    "parallel_trends",
    f"""{_DID}, {_MEANS}
SELECT 'Treated (improved selection)' AS "group", treated_pre AS pre_outcome, treated_post AS post_outcome FROM means
UNION ALL SELECT 'Control (stable selection)', control_pre, control_post FROM means""",
)
def parallel_trends(spark, sf_dir):
    return causal.parallel_trends(causal.did_means(causal.did_stack(causal.did_groups(_panel(spark, sf_dir)))))


_DID_REPS = f"""{_copies_sql('stack', f"{_ROW_KEY} || '|' || period")}, rep_means AS (
  SELECT replicate, {', '.join(
      f"(CAST(sum({_Y} * k) FILTER ({c}) AS DOUBLE) / 1e9) / nullif(CAST(sum(k) FILTER ({c}) AS DOUBLE), 0) AS {name}"
      for name, c in _CELLS.items())}
  FROM copies GROUP BY 1
), reps AS (SELECT {_DELTA} AS d FROM rep_means)"""


@query(
    "did",
    f"""{_DID}, {_MEANS}, {_DID_REPS}, {_spread_sql('d')}, counts AS (
  SELECT CAST(sum(treated) AS BIGINT) AS n_treated, CAST(sum(control) AS BIGINT) AS n_control FROM grouped)
SELECT {rounded_sql(f'({_DELTA})', 5)} AS did_estimate,
  {', '.join(f"{rounded_sql(c, 4)} AS {c}" for c in _CELLS)}, n_treated, n_control, {rounded_sql('se', 5)} AS se,
  {rounded_sql('lo', 5)} AS ci_lower, {rounded_sql('hi', 5)} AS ci_upper,
  {rounded_sql(p_value_sql(f'(({_DELTA}) / se)'), 4)} AS p_value, CAST(NULL AS VARCHAR) AS message
FROM means, counts, spread""",
)
def did(spark, sf_dir):
    return causal.difference_in_differences(_panel(spark, sf_dir))


# -- sensitivity ---------------------------------------------------------------

_RANKSUM = f"""{_SCORED}, shrunk AS (
  SELECT gamma, treatment, CASE WHEN treatment = 1 THEN actual_pps * (1.0 / gamma) ELSE actual_pps END AS outcome
  FROM weighted, (SELECT 1 + 0.25::DOUBLE * unnest(range(9)) AS gamma)
), ranks AS (
  SELECT *, rank() OVER (PARTITION BY gamma ORDER BY outcome)
    + (count(*) OVER (PARTITION BY gamma, outcome) - 1) / 2.0::DOUBLE AS r FROM shrunk
), tests AS (
  SELECT gamma, sum(CASE WHEN treatment = 1 THEN r ELSE 0 END) AS w, CAST(sum(treatment) AS DOUBLE) AS n1,
    CAST(sum(1 - treatment) AS DOUBLE) AS n2 FROM ranks GROUP BY 1
  HAVING sum(treatment) >= 5 AND sum(1 - treatment) >= 5
), zs AS (
  SELECT gamma, (w - n1 * (n1 + n2 + 1) / 2.0) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0) AS z FROM tests
), ps AS (SELECT gamma, {p_value_sql('z')} AS p FROM zs)"""


@query("sensitivity", f"{_RANKSUM} SELECT gamma, {rounded_sql('p', 4)} AS p_upper, p < 0.05::DOUBLE AS significant FROM ps")
def sensitivity(spark, sf_dir):
    return causal.sensitivity_table(_weighted(spark, sf_dir))


@query("sensitivity_break", f"{_RANKSUM} SELECT min(CASE WHEN NOT p < 0.05::DOUBLE THEN gamma END) AS gamma_break FROM ps")
def sensitivity_break(spark, sf_dir):
    return causal.sensitivity_summary(causal.sensitivity_table(_weighted(spark, sf_dir))).select("gamma_break")
