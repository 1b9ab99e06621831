from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from shotmetrics.functions.numeric import rounded
from shotmetrics.operators import reports


def test_trends_keep_small_months_in_the_windows(spark):
    def month(day, n, p):
        return [(1, 7, "A", "2025-26", "Regular Season", day, p, 1, 10.0, "Mid-Range")] * n

    rows = month("2025-10-05", 25, 0.40) + month("2025-11-05", 3, 0.50) + month("2025-12-05", 25, 0.60)
    schema = "shot_id int, player_id long, player_name string, season string, season_type string, d string, p_make double, shot_made_flag int, shot_distance double, shot_zone_basic string"
    scored = spark.createDataFrame(rows, schema).withColumn("game_date", F.to_date("d"))
    got = {r.month: r for r in reports.monthly_trends(scored).collect()}
    assert set(got) == {"2025-10", "2025-12"}
    assert got["2025-12"].prev_month_xfg_pct == 0.5
    assert got["2025-12"].xfg_delta == pytest.approx(0.1)
    assert got["2025-12"].rolling_3mo_avg_xfg == 0.5
    assert got["2025-10"].prev_month_xfg_pct is None


def test_cohort_ranks_are_among_survivors(scored_rows):
    got = reports.context_cohorts(scored_rows, min_attempts=30).toPandas()
    assert (got.attempts >= 30).all()
    for _, zone in got.groupby("shot_zone"):
        assert sorted(zone.smoe_rank_within_zone) == list(range(1, len(zone) + 1))
    sizes = got.groupby("smoe_quartile").size()
    assert sizes.max() - sizes.min() <= 1


def test_overperformers_have_a_positive_lower_bound(scored_rows, scored_pandas):
    got = reports.overperformers(scored_rows, min_shots=10).toPandas()
    d = scored_pandas.assign(m=scored_pandas.shot_made_flag - scored_pandas.p_make)
    g = d.groupby(["player_id", "season", "season_type"]).m.agg(["size", "mean", lambda v: v.std(ddof=0)])
    g.columns = ["n", "mean", "sd"]
    g = g[g.n >= 10]
    half = (1.96 * g.sd / np.sqrt(g.n)).round(6)
    assert len(got) == (g["mean"].round(4) - half > 0).sum()
    assert (got.smoe - got.smoe_ci_halfwidth > 0).all()
    assert sorted(got.smoe_rank) == sorted(got.smoe.rank(ascending=False, method="min").astype(int))


def test_zone_report_rolls_over_surviving_seasons(scored_rows):
    rows = reports.zone_seasons(scored_rows, min_shots=10, round_output=False).toPandas()
    rows = rows.sort_values(["shot_zone", "season_type", "season"])
    want = rows.groupby(["shot_zone", "season_type"]).avg_xfg.rolling(2, min_periods=1).mean().to_numpy()
    assert np.allclose(rows.rolling_2season_xfg, want)


def test_reports_come_in_their_order(scored_rows):
    rows = reports.in_report_order(reports.zone_seasons(scored_rows, min_shots=10), "zone_seasons").collect()
    keys = [(r.season, r.total_shots) for r in rows]
    assert keys == sorted(keys, reverse=True)


def test_leaderboard_counts_unscored_shots_but_not_in_means(spark):
    rows = [(1, "A", 1, 0.5), (1, "A", 0, None), (2, "B", 1, 0.25)]
    scored = spark.createDataFrame(rows, "player_id long, player_name string, shot_made_flag int, p_make double")
    metrics = reports.player_metrics(scored)
    a = metrics.where("player_id = 1").first()
    assert (a.attempts, a.fg_pct, a.xfg_pct, a.smoe, a.shot_diet_difficulty) == (2, 50.0, 50.0, 0.0, 50.0)
    top = reports.leaderboard(metrics, "smoe", min_attempts=1, top_n=1, headings=True)
    assert top.columns == ["Player", "Attempts", "FG%", "xFG%", "SMOE", "Shot Diet Difficulty"]
    assert top.first()["Player"] == "B"
    assert reports.leaderboard(metrics, "attempts", ascending=True, min_attempts=1).first().player_name == "B"
    assert reports.leaderboard(metrics).isEmpty()
    with pytest.raises(ValueError, match="sort_by"):
        reports.leaderboard(metrics, "nonsense")


def test_kpis_without_scores(spark):
    scored = spark.createDataFrame([(1, None), (0, None)], "shot_made_flag int, p_make double")
    row = reports.kpis(scored).first()
    assert (row.attempts, row.fg_pct, row.xfg_pct, row.smoe, row.shot_diet_difficulty) == (2, 0.5, None, None, None)


def test_rounded_columns(spark):
    row = rounded(spark.createDataFrame([(1.23456, 2.5)], "a double, b double"), {"a": 2}).first()
    assert tuple(row) == (1.23, 2.5)
