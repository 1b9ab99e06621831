"""Ranks, quantiles, calibration, drift, monitoring against NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from shotmetrics.operators import calibration, drift, ranking
from shotmetrics.operators.lineage import checkpointed
from shotmetrics.plans import monitoring
from shotmetrics.sources import artifacts


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value; the rest spread, with a far outlier."""
    base = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 5.0).otherwise((F.col("id") * 7919 % 1009) / F.lit(17.0)).alias("x")
    )
    return base.unionByName(spark.createDataFrame([(1e12,), (None,), (float("nan"),)], "x double"))


def test_quantiles_equal_numpy(skewed):
    data = np.array([r.x for r in skewed.collect() if r.x is not None and r.x == r.x])
    probs = ranking.quantile_steps(10) + [0.667, 0.025]
    row = ranking.exact_quantiles(skewed, "x", probs).first()
    assert row.n == len(data)
    assert row.quantiles == list(np.quantile(data, probs))


def test_quantiles_per_group(spark, skewed):
    both = skewed.withColumn("g", F.lit("a")).unionByName(skewed.select((F.col("x") * 2).alias("x"), F.lit("b").alias("g")))
    rows = {r.g: r.quantiles for r in ranking.exact_quantiles(both, "x", [0.1, 0.5], by=["g"]).collect()}
    assert [2 * v for v in rows["a"]] == pytest.approx(rows["b"])
    assert ranking.exact_quantiles(both.where("g = 'z'"), "x", [0.5]).isEmpty()


def test_running_totals_span_ranges(spark):
    counted = checkpointed(spark.range(500).select((F.col("id") * 37 % 501).cast("double").alias("v"), (F.col("id") % 4).alias("n")))
    got = ranking.running_totals(counted, "v", ["n"], ranges=7).orderBy("v").toPandas()
    assert (got.before_n == got.n.cumsum() - got.n).all()
    assert (got.all_n == got.n.sum()).all()


@pytest.mark.parametrize("rows", [1, 4, 23, 500])
def test_positions_equal_sql_windows(spark, rows):
    df = spark.range(rows).select(
        F.col("id").alias("player"), (F.col("id") * 31 % 7 / F.lit(10.0)).alias("s"), F.lit("x").alias("name")
    )
    got = ranking.scored_positions(df, "s", "player", ["player", "name"], tiles=5)
    df.createOrReplaceTempView("positions")
    want = spark.sql(
        "SELECT player, rank() OVER (ORDER BY s DESC) AS r, ntile(5) OVER (ORDER BY s DESC, player % 64, player) AS t FROM positions"
    )
    assert {(r.player, r.position_rank, r.tile) for r in got.collect()} == {tuple(r) for r in want.collect()}


def test_calibration_bins_at_edges(spark):
    p = [0.0, 0.1, 0.3, 0.30000000000000004, 0.6, 0.7, 1.0, 0.55]
    y = [0, 0, 1, 0, 1, 1, 1, 0]
    rows = spark.createDataFrame(list(zip(p, y, strict=True)), "p double, y int")
    row = calibration.calibration_metrics(rows, "p", "y").first()
    q, t = np.clip(p, 1e-7, 1 - 1e-7), np.array(y, float)
    edges = np.linspace(0, 1, 11)
    ece = 0.0
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        m = (q >= lo) & (q < hi)
        if m.any():
            ece += m.sum() / len(q) * abs(q[m].mean() - t[m].mean())
    assert row.ece == pytest.approx(ece, abs=1e-8)
    assert row.brier_score == pytest.approx(np.mean((q - t) ** 2), abs=1e-8)
    assert row.log_loss == pytest.approx(-np.mean(t * np.log(q) + (1 - t) * np.log(1 - q)), abs=1e-8)


def test_calibration_of_nothing(spark):
    row = calibration.calibration_metrics(spark.createDataFrame([], "p double, y int"), "p", "y").first()
    assert (row.n_predictions, row.brier_score, row.ece) == (0, None, None)


def test_calibration_curve_equals_numpy(scored_rows, scored_pandas):
    p, y = scored_pandas.p_make.to_numpy(), scored_pandas.shot_made_flag.to_numpy()
    edges = np.quantile(p, np.linspace(0, 1, 13))
    bins = np.searchsorted(edges[1:-1], p)
    got = calibration.calibration_curve(scored_rows, "p_make", "shot_made_flag").orderBy("bin").collect()
    assert [r.bin for r in got] == sorted(set(bins))
    for r in got:
        assert r.n == (bins == r.bin).sum()
        assert r.mean_predicted == pytest.approx(p[bins == r.bin].mean(), abs=1e-8)
        assert r.observed_rate == pytest.approx(y[bins == r.bin].mean())


def _psi(base, recent):
    edges = np.quantile(base, np.linspace(0, 1, 11))
    edges[0] -= 1e-6
    edges[-1] += 1e-6
    e, _ = np.histogram(base, edges)
    a, _ = np.histogram(recent, edges)
    e, a = np.clip(e / e.sum(), 1e-6, None), np.clip(a / a.sum(), 1e-6, None)
    return float(np.sum((a - e) * np.log(a / e)))


def test_numeric_drift_equals_numpy(scored_rows, scored_pandas):
    recent = scored_rows.where("season = '1997-98'").withColumn("loc_x", F.col("loc_x") * 1.4)
    r = scored_pandas[scored_pandas.season == "1997-98"]
    got = {x.feature: x for x in drift.psi_numeric(recent, scored_rows).collect()}
    assert got["loc_x"].psi == pytest.approx(_psi(scored_pandas.loc_x, r.loc_x * 1.4), abs=2e-6)
    assert got["shot_distance"].psi == pytest.approx(_psi(scored_pandas.shot_distance, r.shot_distance), abs=2e-6)
    for row in got.values():
        assert row.status == ("ok" if row.psi < 0.1 else "warn" if row.psi < 0.25 else "alert")


def test_no_drift_against_itself_and_empty_sides(scored_rows):
    same = drift.drift_report(scored_rows, scored_rows).collect()
    assert {(r.psi, r.status) for r in same} == {(0.0, "ok")} and len(same) == 5
    none = drift.drift_report(scored_rows.where("season = 'never'"), scored_rows).collect()
    # without recent numbers nothing is said of them; categories that vanished alert
    assert {r.feature: r.status for r in none} == {
        "loc_x": "ok", "loc_y": "ok", "shot_distance": "ok", "shot_zone_basic": "alert", "shot_type": "alert",
    }


def test_new_category_alerts(spark, scored_rows):
    odd = scored_rows.withColumn("shot_type", F.lit("4PT"))
    got = {r.feature: r.status for r in drift.psi_categorical(odd, scored_rows).collect()}
    assert got == {"shot_zone_basic": "ok", "shot_type": "alert"}


def test_profile_and_shares(scored_rows, scored_pandas):
    got = {r.feature: r for r in drift.feature_profile(scored_rows).collect()}
    y = scored_pandas.loc_y.to_numpy()
    assert got["loc_y"].mean == pytest.approx(y.mean())
    assert got["loc_y"].std == pytest.approx(y.std())
    assert [got["loc_y"][f"p{p}"] for p in drift.PROFILE_PERCENTS] == list(np.percentile(y, drift.PROFILE_PERCENTS))
    shares = drift.category_shares(scored_rows, ["shot_zone_area"]).toPandas().set_index("category").share
    want = scored_pandas.shot_zone_area.value_counts(normalize=True).round(6)
    assert shares.to_dict() == pytest.approx(want.to_dict())


def test_recent_window(scored_rows, scored_pandas):
    newest = pd.to_datetime(scored_pandas.game_date).max()
    want = (pd.to_datetime(scored_pandas.game_date) >= newest - pd.Timedelta(days=30)).sum()
    assert drift.recent_window(scored_rows, 30).count() == want
    one = drift.recent_window(scored_rows, 30, "1997-98", "Regular Season")
    assert {r.season for r in one.select("season").distinct().collect()} == {"1997-98"}
    assert drift.recent_window(scored_rows, None).count() == len(scored_pandas)


def test_report_alerts_persists_and_reads_back(spark, scored_rows, tmp_path):
    history, log = str(tmp_path / "history"), str(tmp_path / "log")
    calm = monitoring.run_monitoring(scored_rows, history, log, baseline_brier=0.9, window_days=0).first()
    assert (calm.alert_triggered, calm.alert_message) == (False, "All checks passed.")
    bad = monitoring.run_monitoring(scored_rows, history, log, baseline_brier=0.1, window_days=0).first()
    assert bad.alert_triggered and bad.alert_message.startswith("Brier score 0.2")
    none = monitoring.run_monitoring(scored_rows, history, log, season="2050-51").first()
    assert (none.n_predictions, none.brier_score, none.alert_triggered) == (0, None, False)
    assert none.alert_message == "No predictions found in the last 30 days."
    kept = artifacts.read_history(spark, history)
    assert kept.count() == 3 and spark.read.parquet(log).count() == 3
    assert artifacts.latest_report(kept).first().season == "2050-51"
    assert artifacts.history_series(kept).count() == 2
    rows = drift.drift_rows(kept.where("n_predictions > 0"))
    assert rows.count() == 10


def test_alert_names_the_drifted_feature(spark, scored_rows):
    early = scored_rows.withColumn("shot_type", F.lit("4PT"))
    row = monitoring.monitoring_report(scored_rows, baseline_shots=early, window_days=0).first()
    assert row.alert_triggered and "Feature 'shot_type' PSI = " in row.alert_message and "(> 0.25)." in row.alert_message


def test_baseline_record(spark, scored_rows, tmp_path):
    season = drift.largest_season(scored_rows).first()
    record = monitoring.baseline_record(scored_rows, season.season, season.season_type)
    artifacts.save_baseline(record, str(tmp_path / "baseline"))
    row = artifacts.load_baseline(spark, str(tmp_path / "baseline")).first()
    assert row.n_shots == season.n_shots
    assert row.numeric_distributions.loc_x.p50 is not None
    assert sum(v for v in row.category_distributions.shot_type.asDict().values()) == pytest.approx(1, abs=1e-5)
