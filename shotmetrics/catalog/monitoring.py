"""Calibration, drift, profiles, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import round_half_away
from ..functions.seasons import month_key
from ..operators import calibration, drift
from ..plans.monitoring import METRICS, baseline_record, monitoring_report
from ..sources.artifacts import history_series, latest_report
from ..sources.star_schema import predictions
from .base import ORACLES, fixture_sql, joined, query, rounded_sql, stored_once, units_sql

R6 = rounded_sql


def _log_loss_sql(p: str) -> str:
    return units_sql(f"CASE WHEN shot_made_flag = 1 THEN -ln({p}) ELSE -ln(1 - {p}) END")


_SQUARE = "(10000 * shot_made_flag - p4) * (10000 * shot_made_flag - p4)"
_BRIER = f"(CAST(sum({_SQUARE}) AS DOUBLE) / (count(*) * 100000000))"
# which of the ten bins: edges are i * 0.1 as doubles
_BIN10 = " + ".join(f"CASE WHEN p_make >= {i} * 0.1::DOUBLE THEN 1 ELSE 0 END" for i in range(1, 10))


def _calibration_sql(rows: str, keys: str = "") -> str:
    """CTE cal with the metrics of a rows CTE, per key columns."""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""cal_bins AS (
  SELECT {lead}{_BIN10} AS bin, count(*) AS n, sum(p4) - 10000 * sum(shot_made_flag) AS gap,
    sum({_SQUARE}) AS sq, sum({_log_loss_sql('p_make')}) AS ll
  FROM {rows} GROUP BY ALL
), cal AS (
  SELECT {lead}CAST(sum(sq) AS DOUBLE) / (sum(n) * 100000000) AS brier_score,
    CAST(sum(abs(gap)) AS DOUBLE) / (sum(n) * 10000) AS ece, CAST(sum(ll) AS DOUBLE) / (sum(n) * 1e9) AS log_loss,
    CAST(sum(n) AS BIGINT) AS n_predictions
  FROM cal_bins {group})"""


_ROUNDED = ", ".join(f"{R6(c, 6)} AS {c}" for c in METRICS)


def _rounded_metrics(df):
    return df.withColumns({c: round_half_away(F.col(c), 6) for c in METRICS if c in df.columns})


@query(
    "calibration_metrics",
    f"{fixture_sql()}, {_calibration_sql('scored', 'season, season_type')} SELECT season, season_type, {_ROUNDED}, n_predictions FROM cal",
)
def calibration_metrics(spark, sf_dir):
    found = calibration.calibration_metrics(joined(spark, sf_dir), "p_make", "shot_made_flag", by=["season", "season_type"])
    return _rounded_metrics(found)


@query(
    "binary_metrics",
    f"""{fixture_sql()}, m AS (
  SELECT player_id, CAST(sum({_log_loss_sql('p_make')}) AS DOUBLE) / (count(*) * 1e9) AS log_loss, {_BRIER} AS brier_score
  FROM scored GROUP BY 1)
SELECT player_id, {R6('log_loss', 6)} AS log_loss, {R6('brier_score', 6)} AS brier_score FROM m""",
)
def binary_metrics(spark, sf_dir):
    return _rounded_metrics(calibration.binary_metrics(joined(spark, sf_dir), "p_make", "shot_made_flag", by=["player_id"]))


def quantile_sql(values: str, q: str) -> str:
    """Interpolated quantile of a sorted list, from the nearer end."""
    at = f"({q} * (len({values}) - 1)::DOUBLE)"
    lo = f"{values}[CAST(floor({at}) AS BIGINT) + 1]"
    hi = f"{values}[CAST(ceil({at}) AS BIGINT) + 1]"
    t = f"({at} - floor({at}))"
    return f"(CASE WHEN {t} >= 0.5 THEN {hi} - ({hi} - {lo}) * (1 - {t}) ELSE {lo} + ({hi} - {lo}) * {t} END)"


def _edges_sql(source: str, value: str, bins: int) -> str:
    steps = [f"({i} * (1.0::DOUBLE / {bins}))" for i in range(bins)] + ["1.0::DOUBLE"]
    edges = ", ".join(quantile_sql("vs", q) for q in steps)
    return f"SELECT [{edges}] AS q FROM (SELECT list_sort(list({value})) AS vs FROM {source})"


_BELOW = " + ".join(f"CASE WHEN q[{i + 1}] < p_make THEN 1 ELSE 0 END" for i in range(1, 12))


@query(
    "calibration_curve",
    f"""{fixture_sql()}, edges AS ({_edges_sql('scored', 'p_make', 12)})
SELECT {_BELOW} AS bin, count(*) AS n, CAST(sum(p4) AS DOUBLE) / (count(*) * 10000) AS mean_predicted,
  CAST(sum(shot_made_flag) AS DOUBLE) / count(*) AS observed_rate
FROM scored, edges GROUP BY 1""",
)
def calibration_curve(spark, sf_dir):
    return calibration.calibration_curve(joined(spark, sf_dir), "p_make", "shot_made_flag")


# -- drift ---------------------------------------------------------------------

_ALL = [*drift.NUMERIC_DRIFT, *drift.CATEGORY_DRIFT]
_WINDOW = "recent AS (SELECT * FROM scored WHERE game_date >= (SELECT max(game_date) FROM scored) - 30)"


def _drift_rows(spark, sf_dir):
    """What monitoring reads, and its recent part."""
    columns = ["game_date", "season", "season_type", "p_make", "shot_made_flag", *_ALL]
    rows = stored_once(joined(spark, sf_dir).select(*columns))
    return drift.recent_window(rows, 30), rows


@query(
    "recent_window",
    f"{fixture_sql()}, {_WINDOW} SELECT shot_id, game_date, p_make, shot_made_flag, loc_x, loc_y, shot_distance FROM recent",
)
def recent_window(spark, sf_dir):
    columns = ["shot_id", "game_date", "p_make", "shot_made_flag", "loc_x", "loc_y", "shot_distance"]
    return drift.recent_window(joined(spark, sf_dir), 30, dates=predictions(spark, sf_dir)).select(*columns)


def _numeric_psi_sql(feature: str) -> str:
    number = " + ".join(f"CASE WHEN v >= q[{i + 1}] THEN 1 ELSE 0 END" for i in range(1, 10))
    return f"""SELECT '{feature}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM (
    SELECT greatest(CAST(e AS DOUBLE) / sum(e) OVER (), 1e-6) AS e, greatest(CAST(a AS DOUBLE) / sum(a) OVER (), 1e-6) AS a
    FROM (
      SELECT {number} AS bucket, sum(CASE WHEN late THEN 0 ELSE 1 END) AS e, sum(CASE WHEN late THEN 1 ELSE 0 END) AS a
      FROM (SELECT {feature} AS v, true AS late FROM recent UNION ALL SELECT {feature}, false FROM scored),
        ({_edges_sql('scored', feature, 10)})
      WHERE v >= q[1] - 1e-6 AND v <= q[11] + 1e-6 GROUP BY 1))"""


def _category_psi_sql(feature: str) -> str:
    def share(side: str) -> str:
        return f"greatest(coalesce(CAST({side} AS DOUBLE) / nullif(sum({side}) OVER (), 0), 0), 1e-6) AS {side}"

    return f"""SELECT '{feature}' AS feature, sum((a - e) * ln(a / e)) AS psi FROM (
    SELECT {share('e')}, {share('a')}
    FROM (SELECT v, sum(CASE WHEN late THEN 0 ELSE 1 END) AS e, sum(CASE WHEN late THEN 1 ELSE 0 END) AS a
      FROM (SELECT {feature} AS v, true AS late FROM recent UNION ALL SELECT {feature}, false FROM scored)
      WHERE v IS NOT NULL GROUP BY 1))"""


def _psi_sql(features: list[str]) -> str:
    parts = [_numeric_psi_sql(f) if f in drift.NUMERIC_DRIFT else _category_psi_sql(f) for f in features]
    return f"""psi_raw AS ({' UNION ALL '.join(parts)}), psi AS (
  SELECT feature, {R6('psi', 6)} AS psi,
    CASE WHEN {R6('psi', 6)} < 0.1 THEN 'ok' WHEN {R6('psi', 6)} < 0.25 THEN 'warn' ELSE 'alert' END AS status FROM psi_raw)"""


@query("psi_numeric", f"{fixture_sql()}, {_WINDOW}, {_psi_sql(drift.NUMERIC_DRIFT)} SELECT * FROM psi")
def psi_numeric(spark, sf_dir):
    return drift.psi_numeric(*_drift_rows(spark, sf_dir))


@query("psi_categorical", f"{fixture_sql()}, {_WINDOW}, {_psi_sql(drift.CATEGORY_DRIFT)} SELECT * FROM psi")
def psi_categorical(spark, sf_dir):
    return drift.psi_categorical(*_drift_rows(spark, sf_dir))


@query("drift_rows", f"{fixture_sql()}, {_WINDOW}, {_psi_sql(_ALL)} SELECT * FROM psi")
def drift_rows(spark, sf_dir):
    return drift.drift_rows(drift.drift_map(drift.drift_report(*_drift_rows(spark, sf_dir))))


@query(
    "feature_profile",
    f"{fixture_sql()}"
    + " UNION ALL ".join(
        f"""
SELECT '{f}' AS feature, mean, sqrt(greatest(m2 - mean * mean, 0)) AS std,
  {', '.join(f"{quantile_sql('vs', f'{p / 100}::DOUBLE')} AS p{p}" for p in drift.PROFILE_PERCENTS)}
FROM (SELECT CAST(sum(CAST({f} AS BIGINT)) AS DOUBLE) / count(*) AS mean,
        CAST(sum(CAST({f} AS BIGINT) * CAST({f} AS BIGINT)) AS DOUBLE) / count(*) AS m2, list_sort(list({f})) AS vs FROM scored)"""
        for f in drift.NUMERIC_DRIFT
    ),
)
def feature_profile(spark, sf_dir):
    return drift.feature_profile(joined(spark, sf_dir))


@query(
    "category_shares",
    f"{fixture_sql()}"
    + " UNION ALL ".join(
        f"""
SELECT '{f}' AS feature, {f} AS category, count(*) AS n,
  {R6('(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ())', 6)} AS share FROM shots WHERE {f} IS NOT NULL GROUP BY {f}"""
        for f in [*drift.CATEGORY_DRIFT, "shot_zone_area"]
    ),
)
def category_shares(spark, sf_dir):
    return drift.category_shares(joined(spark, sf_dir), [*drift.CATEGORY_DRIFT, "shot_zone_area"])


_LARGEST = """SELECT season, season_type, count(*) AS n_shots FROM shots GROUP BY 1, 2
ORDER BY n_shots DESC, season, season_type LIMIT 1"""


@query("largest_season", f"{fixture_sql()} {_LARGEST}")
def largest_season(spark, sf_dir):
    return drift.largest_season(joined(spark, sf_dir))


_BEST = f"best AS ({_LARGEST}), season_rows AS (SELECT s.* FROM scored s JOIN best b ON b.season = s.season AND b.season_type = s.season_type)"


@query(
    "baseline_record",
    f"""{fixture_sql()}, {_BEST}, {_calibration_sql('season_rows')}
SELECT season, season_type, n_predictions AS n_shots, {_ROUNDED} FROM cal, best""",
)
def baseline_record_(spark, sf_dir):
    rows = stored_once(joined(spark, sf_dir).select("season", "season_type", "p_make", "shot_made_flag", *_ALL))
    season, season_type, _ = drift.largest_season(rows).first()
    record = baseline_record(rows, season, season_type)
    return record.drop("numeric_distributions", "category_distributions")


@query(
    "monitoring_report",
    f"""{fixture_sql()}, {_WINDOW}, {_calibration_sql('recent')}, {_psi_sql(_ALL)},
b AS (SELECT 0.2::DOUBLE AS baseline_brier),
late AS (SELECT coalesce(bool_or(status = 'alert'), false) AS drifted FROM psi)
SELECT 'all' AS season, 'Regular Season' AS season_type, {_ROUNDED}, n_predictions,
  brier_score > baseline_brier * 1.15::DOUBLE OR drifted AS alert_triggered,
  CASE WHEN brier_score > baseline_brier * 1.15::DOUBLE THEN
    printf('Brier score %.4f exceeds baseline %.4f × 1.15 (%.4f).', brier_score, baseline_brier, baseline_brier * 1.15::DOUBLE)
    WHEN NOT drifted THEN 'All checks passed.' END AS alert_message, baseline_brier
FROM cal, b, late""",
)
def monitoring_report_(spark, sf_dir):
    return monitoring_report(_drift_rows(spark, sf_dir)[1], baseline_brier=0.2).drop("timestamp", "drift_report")


@query("monitoring_drift", ORACLES["drift_rows"])
def monitoring_drift(spark, sf_dir):
    """The drift map of the whole report, as rows."""
    return drift.drift_rows(monitoring_report(_drift_rows(spark, sf_dir)[1]).select("drift_report"))


@query(
    "baseline_shares",
    f"{fixture_sql()}, {_BEST}"
    + " UNION ALL ".join(
        f"""
SELECT '{f}' AS feature, {f} AS category,
  {R6('(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ())', 6)} AS share FROM season_rows WHERE {f} IS NOT NULL GROUP BY {f}"""
        for f in drift.CATEGORY_DRIFT
    ),
)
def baseline_shares(spark, sf_dir):
    """The category distributions of the baseline record, as rows."""
    rows = stored_once(joined(spark, sf_dir).select("season", "season_type", "p_make", "shot_made_flag", *_ALL))
    season, season_type, _ = drift.largest_season(rows).first()
    record = baseline_record(rows, season, season_type)
    by_feature = record.select(F.explode("category_distributions").alias("feature", "shares"))
    return by_feature.select("feature", F.explode("shares").alias("category", "share"))


@query("psi_vanished", f"""{fixture_sql()}, {_WINDOW}, gone AS (SELECT * REPLACE (NULL AS shot_type) FROM recent),
{_psi_sql(drift.CATEGORY_DRIFT).replace('FROM recent', 'FROM gone')} SELECT * FROM psi""")
def psi_vanished(spark, sf_dir):
    """Drift when a category has no recent value left."""
    recent, rows = _drift_rows(spark, sf_dir)
    return drift.psi_categorical(recent.withColumn("shot_type", F.lit(None).cast("string")), rows)


def _history(spark, sf_dir):
    """One report per month of games, as if the job had run at each month's end."""
    rows = joined(spark, sf_dir).withColumn("month", month_key(F.col("game_date")))
    monthly = calibration.calibration_metrics(rows, "p_make", "shot_made_flag", by=["month"])
    stamp = F.last_day(F.to_date(F.concat("month", F.lit("-01")))).cast("timestamp")
    # months with few shots count as runs that found nothing
    enough = F.col("n_predictions") >= 500
    return monthly.select(
        stamp.alias("timestamp"), F.when(enough, round_half_away(F.col("brier_score"), 6)).alias("brier_score"), "n_predictions"
    )


_HISTORY = f"""by_month AS (SELECT *, strftime(game_date, '%Y-%m') AS month FROM scored), {_calibration_sql('by_month', 'month')},
history AS (SELECT last_day(CAST(month || '-01' AS DATE)) AS run_date,
  CASE WHEN n_predictions >= 500 THEN {R6('brier_score', 6)} END AS brier_score, n_predictions FROM cal)"""


@query("history_series", f"{fixture_sql()}, {_HISTORY} SELECT run_date, brier_score FROM history WHERE brier_score IS NOT NULL")
def history_series_(spark, sf_dir):
    return history_series(_history(spark, sf_dir))


@query("latest_report", f"{fixture_sql()}, {_HISTORY} SELECT run_date, brier_score, n_predictions FROM history ORDER BY run_date DESC LIMIT 1")
def latest_report_(spark, sf_dir):
    return latest_report(_history(spark, sf_dir)).select(F.to_date("timestamp").alias("run_date"), "brier_score", "n_predictions")
