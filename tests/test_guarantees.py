"""What must hold whatever the data: no value dropped, no stored row lost, no season read in vain."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from shotmetrics.functions.numeric import DISTANCE_UNIT, exact_mean, exact_weighted_mean
from shotmetrics.operators import bootstrap, drift, ranking, reports
from shotmetrics.operators.calibration import binary_metrics
from shotmetrics.plans import ingest, monitoring
from shotmetrics.sources.artifacts import load_baseline
from shotmetrics.sources.tables import ShotStore, new_rows, of_partitions, unscored


@pytest.mark.parametrize(
    "values", [[1e13, 2e13, 3.0], [1e18, 3e18], [0.5, 0.25], [1e300, 2.0], [None, 4.0], [float("nan"), 4.0]]
)
def test_means_count_every_value(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = [v for v in values if v is not None and not math.isnan(v)]
    got = df.agg(exact_mean(F.col("v")).alias("m"), exact_weighted_mean(F.col("v"), F.lit(2), DISTANCE_UNIT).alias("w")).first()
    assert got.m == pytest.approx(sum(known) / len(known), rel=1e-12)
    assert got.w == pytest.approx(sum(known) / len(known), rel=1e-12)


def test_infinity_is_kept(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (math.inf,), (3.0,)], "v double")
    assert df.agg(exact_mean(F.col("v"))).first()[0] == math.inf
    row = ranking.exact_quantiles(df, "v", [0.0, 0.5]).first()
    assert row.n == 4 and row.quantiles[0] == 1.0 and row.quantiles[1] == 2.5


def test_profile_of_large_values(spark):
    df = spark.createDataFrame([(1e13,), (2e13,)], "v double")
    row = drift.feature_profile(df, ["v"]).first()
    assert row["mean"] == 1.5e13 and row["std"] == pytest.approx(5e12)


def test_quantiles_of_many_groups(spark):
    df = spark.range(6000).selectExpr("id % 1500 as player_id", "cast(id div 1500 as double) as v")
    got = ranking.exact_quantiles(df, "v", [0.5], by=["player_id"]).collect()
    assert len(got) == 1500 and {r.quantiles[0] for r in got} == {1.5}


def test_missing_label_is_no_miss(spark):
    df = spark.createDataFrame([(0.9, 1), (0.9, None), (0.2, 0)], "p double, y int")
    row = binary_metrics(df, "p", "y").first()
    assert row.log_loss == pytest.approx((-math.log(0.9) - math.log(0.8)) / 2, abs=1e-8)
    assert row.brier_score == pytest.approx((0.01 + 0.04) / 2)


def test_flat_replicates(spark):
    point = spark.createDataFrame([(0.2,)], "ate double")
    flat = spark.createDataFrame([(0.0, 0.2, 0.2)], "se double, ci_lower double, ci_upper double")
    assert bootstrap.with_spread(point, "ate", flat).first().p_value == 1.0
    assert bootstrap.with_spread(point, "ate", flat, flat_p=None).first().p_value is None


def test_draws_use_several_tasks(spark, scored_rows):
    rows = scored_rows.limit(500).coalesce(1)
    plan = bootstrap.replicate_sums(rows, ["shot_id"], {"x": F.col("p_make")}, replicates=8)
    assert "Exchange hashpartitioning(_key" in plan._jdf.queryExecution().executedPlan().toString()


# -- the stored season ---------------------------------------------------------


def _dump(path, rows):
    path.mkdir(parents=True, exist_ok=True)
    base = {"LOC_X": 1, "LOC_Y": 2, "SHOT_MADE_FLAG": 1, "SHOT_DISTANCE": 3, "GAME_DATE": "2025-11-02"}
    lines = [
        json.dumps(base | {"PLAYER_ID": p, "PLAYER_NAME": f"P{p}", "GAME_ID": g, "GAME_EVENT_ID": e, "SEASON": s, "SEASON_TYPE": "Regular Season"})
        for p, g, e, s in rows
    ]
    (path / "part.json").write_text("\n".join(lines))
    return str(path)


def test_refresh_keeps_players_the_dump_does_not_renew(spark, tmp_path):
    store = ShotStore(spark, str(tmp_path / "store"))
    first = _dump(tmp_path / "a", [(1, "g1", 1, "2025-26"), (2, "g2", 2, "2025-26")])
    assert ingest.ensure_season(store, first, "2025-26").count() == 2
    second = _dump(tmp_path / "b", [(1, "g1", 1, "2024-25"), (2, "g9", 9, "2025-26"), (2, "g8", 8, "2025-26")])
    rows = ingest.ensure_season(store, second, "2025-26", force_refresh=True).collect()
    assert sorted((r.player_id, r.game_id) for r in rows) == [(1, "g1"), (2, "g8"), (2, "g9")]


def test_players_are_those_of_the_season(spark, tmp_path):
    store = ShotStore(spark, str(tmp_path / "store"))
    dump = _dump(tmp_path / "a", [(1, "g1", 1, "2024-25"), (2, "g2", 2, "2025-26")])
    assert [r.player_id for r in ingest.ensure_season(store, dump, "2025-26", max_players=1).collect()] == [2]
    with pytest.raises(ingest.NoPlayers):
        ingest.ensure_season(store, dump, "1999-00")


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in plan.splitlines() if "FileScan" in line]


def test_a_season_prunes_both_tables(spark, scored_rows, tmp_path):
    store = ShotStore(spark, str(tmp_path / "store"))
    rows = scored_rows.where("season in ('1996-97', '1997-98')")
    assert store.upsert(rows) == rows.count()
    assert store.upsert(rows) == 0
    stored = store.shots().withColumn("p_make", F.lit(0.5))
    added = store.add_predictions(stored)
    assert added == stored.count() == store.predictions().count()
    assert store.add_predictions(stored) == 0
    report = reports.join_predictions(store.shots(), store.predictions()).where("season = '1996-97'")
    assert len(_scans(report)) >= 2 and all("= 1996-97" in filters for filters in _scans(report))
    todo = unscored(store.shots(), store.predictions()).where("season = '1996-97'")
    assert len(_scans(todo)) >= 2 and all("= 1996-97" in filters for filters in _scans(todo))
    batch = rows.where("season = '1997-98'")
    added = new_rows(batch, of_partitions(store.shots(), batch))
    assert any("= 1997-98" in filters for filters in _scans(added))


def test_monitoring_compares_with_the_stored_baseline(spark, scored_rows, tmp_path):
    folder = str(tmp_path / "baseline")
    record = monitoring.establish_baseline(scored_rows, folder).first()
    assert load_baseline(spark, folder).first().brier_score == record.brier_score
    report = monitoring.run_monitoring(scored_rows, str(tmp_path / "h"), str(tmp_path / "l"), folder, window_days=0).first()
    assert report.baseline_brier == record.brier_score
    empty = monitoring.establish_baseline(scored_rows.limit(0), str(tmp_path / "none")).first()
    assert (empty.season, empty.n_shots) == ("2023-24", 0)


def test_monitoring_judges_the_stored_outcome(spark, scored_rows):
    shots = scored_rows.drop("p_make").withColumn("shot_made_flag", F.lit(0))
    stored = scored_rows.select("shot_id", "season", "season_type", F.lit(0.9).alias("predicted_make_prob"), F.lit(1).alias("actual_make"))
    joined = reports.join_predictions(shots, stored, outcome=True)
    assert monitoring.monitoring_report(joined, window_days=0).first().brier_score == pytest.approx(0.01)
