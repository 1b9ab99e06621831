from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from shotmetrics.operators import players
from shotmetrics.plans import ingest
from shotmetrics.plans.sql_reports import register_views, run_sql, run_sql_file
from shotmetrics.sources import landing, tables
from shotmetrics.sources.tables import ShotStore, new_rows
from shotmetrics.streaming.landing import fill_from_landing

SEASON = "2025-26"
COLUMNS = (
    "season string, season_type string, player_id long, player_name string, team_id long, team_name string, "
    "game_id string, game_event_id long, game_date string, loc_x double, loc_y double, shot_made_flag int, "
    "shot_distance double, shot_type string, action_type string, shot_zone_basic string, shot_zone_area string, "
    "shot_zone_range string"
)


def shot(event=10, player=7, game="0022500001", x=10.0, made=1, season=SEASON, name="Someone"):
    return (
        season, "Regular Season", player, name, 1, "Team", game, event, "2025-10-21", x, 40.0, made, 5.0,
        "2PT Field Goal", "Driving Layup Shot", "Restricted Area", "Center(C)", "Less Than 8 ft.",
    )


def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture
def store(spark, tmp_path):
    return ShotStore(spark, str(tmp_path / "store"))


def test_round_trip_and_idempotent_insert(spark, store):
    rows = frame(spark, [shot(10), shot(11, x=-200.0, made=0)])
    assert store.upsert(rows) == 2
    loaded = store.player_shots(7, SEASON).collect()
    assert [r.game_event_id for r in loaded] == [10, 11]
    assert loaded[0].game_id == "0022500001"
    assert str(loaded[0].game_date) == "2025-10-21"
    assert store.season_count(SEASON) == 2
    assert store.upsert(rows) == 0
    assert store.has_player(7, SEASON) and not store.has_player(8, SEASON)
    store.initialize()
    assert store.season_count(SEASON) == 2


def test_insert_rules(spark, store):
    rows = [shot(1), shot(1), shot(None), shot(None), shot(2, game=None), shot(3, x=None), shot(4, player=None)]
    assert store.upsert(frame(spark, rows)) == 4
    # incomplete keys are never duplicates
    assert store.upsert(frame(spark, rows)) == 3
    ids = [r.shot_id for r in store.shots().collect()]
    assert len(set(ids)) == len(ids) == 7


def test_hot_copies_leave_one_row(spark):
    copies = frame(spark, [shot(1)]).crossJoin(spark.range(5000).repartition(4)).drop("id")
    others = frame(spark, [shot(i) for i in range(2, 50)])
    stored = frame(spark, [shot(2), shot(3)])
    assert new_rows(copies.unionByName(others), stored).count() == 47


def test_new_row_is_the_same_whatever_the_order(spark):
    rows = frame(spark, [shot(1, name=n) for n in "CBA"])
    got = {new_rows(rows.repartition(n), rows.limit(0)).first().player_name for n in (1, 2, 3)}
    assert got == {"A"}


def test_delete_and_refresh(spark, store):
    store.upsert(frame(spark, [shot(i) for i in range(5)] + [shot(i, player=8) for i in range(3)]))
    assert store.delete_player(7, SEASON) == 5
    assert store.delete_player(7, SEASON) == 0
    assert [r.player_id for r in store.season_shots(SEASON).collect()] == [8, 8, 8]
    # the partition's last player goes as well
    assert store.delete_player(8, SEASON) == 3
    assert store.season_count(SEASON) == 0
    assert store.upsert(frame(spark, [shot(1)])) == 1


def raw_line(event, player, name, **more):
    return {
        "GAME_ID": "0022500001", "GAME_EVENT_ID": str(event), "GAME_DATE": "20251021", "PLAYER_ID": str(player),
        "PLAYER_NAME": name, "LOC_X": "10", "LOC_Y": " 40 ", "SHOT_MADE_FLAG": "1", "SHOT_DISTANCE": "4",
        "SHOT_TYPE": "2PT Field Goal", **more,
    }


@pytest.fixture
def dump(tmp_path):
    folder = tmp_path / "dump"
    folder.mkdir()
    lines = [raw_line(i, 7, "Ann") for i in range(3)] + [raw_line(i, 8, "Bob", SHOT_MADE_FLAG="?") for i in range(2)]
    lines += [raw_line(9, "x", "Nobody"), raw_line(5, 8, "Bob", LOC_X="bad")]
    (folder / "a.json").write_text("\n".join(json.dumps(r) for r in lines))
    return str(folder)


def test_standardize(spark, dump):
    rows = landing.standardize(landing.read_landed(spark, dump), SEASON, "Regular Season", 1, "Given")
    first = rows.where("game_event_id = 0").first()
    assert (first.player_id, first.player_name, first.season, first.loc_y, str(first.game_date)) == (1, "Given", SEASON, 40.0, "2025-10-21")
    assert first.team_id is None
    assert rows.where("shot_made_flag = 0").count() == 2
    assert rows.where("loc_x is null").count() == 1


def test_csv_and_parquet_dumps(spark, dump, tmp_path):
    raw = landing.read_landed(spark, dump)
    tables.write_csv(raw.drop("SEASON", "SEASON_TYPE"), str(tmp_path / "csv"))
    raw.write.parquet(str(tmp_path / "pq"))
    want = sorted(landing.standardize(raw, SEASON, "Regular Season").collect(), key=str)
    for fmt, name in (("csv", "csv"), ("parquet", "pq")):
        got = landing.standardize(landing.read_landed(spark, str(tmp_path / name), fmt), SEASON, "Regular Season")
        assert sorted(got.collect(), key=str) == want


def test_ensure_player(spark, store, dump):
    rows = ingest.ensure_player(store, dump, 7, "Ann", SEASON)
    assert rows.count() == 3
    assert ingest.ensure_player(store, dump, 7, "Ann", SEASON).count() == 3
    assert ingest.ensure_player(store, dump, 7, "Ann", SEASON, force_refresh=True).count() == 3
    assert ingest.ensure_player(store, dump, 99, "Missing", SEASON).count() == 0


def test_ensure_season(spark, store, dump):
    rows = ingest.ensure_season(store, dump, SEASON, max_players=1)
    assert {r.player_id for r in rows.collect()} == {7}
    # a stored season is left as it is
    assert ingest.ensure_season(store, dump, SEASON).count() == 3
    assert ingest.ensure_season(store, dump, SEASON, force_refresh=True).count() == 5
    with pytest.raises(ingest.NoPlayers):
        _empty(spark, store)


def _empty(spark, store):
    path = store.root + "-empty"
    spark.createDataFrame([], landing.RAW_SCHEMA).write.json(path)
    return ingest.ensure_season(ShotStore(spark, store.root + "2"), path, SEASON)


def test_stream_fills_once(spark, store, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    line = raw_line(1, 7, "Ann", SEASON=SEASON, SEASON_TYPE="Regular Season")
    (folder / "1.json").write_text(json.dumps(line))
    fill_from_landing(store, str(folder), str(tmp_path / "cp"))
    assert store.season_count(SEASON) == 1
    second = raw_line(2, 7, "Ann", SEASON=SEASON, SEASON_TYPE="Regular Season")
    (folder / "2.json").write_text("\n".join(json.dumps(r) for r in (line, second)))
    fill_from_landing(store, str(folder), str(tmp_path / "cp"))
    assert store.season_count(SEASON) == 2


def test_season_filter_prunes_and_pushes_down(spark, store):
    store.upsert(frame(spark, [shot(1), shot(1, season="2024-25")]))
    plan = store.player_shots(7, SEASON)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan
    assert "EqualTo(player_id,7)" in plan


def test_bucketed_tables_join_without_shuffle(spark, scored_rows):
    tables.save_bucketed(scored_rows.drop("p_make"), "b_shots", 4)
    tables.save_bucketed(scored_rows.select("shot_id", "p_make"), "b_preds", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("b_shots").join(spark.table("b_preds"), "shot_id")
        assert joined.count() == scored_rows.count()
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_saved_sql_with_parameters(spark, scored_rows, tmp_path):
    register_views(scored_rows, scored_rows.select("shot_id", F.col("p_make").alias("predicted_make_prob")))
    text = "SELECT count(*) AS n FROM shots s JOIN predictions p ON p.shot_id = s.shot_id WHERE s.player_id = :who"
    want = scored_rows.where("player_id = 3").count()
    assert run_sql(spark, text, {"who": 3}).first().n == want
    file = tmp_path / "q.sql"
    file.write_text("-- a comment\n" + text.replace(":who", "?"))
    assert run_sql_file(spark, file, [3]).first().n == want
    assert run_sql(spark, "SELECT count(*) AS n FROM shots").first().n == scored_rows.count()


NAMES = [(1, "Ann Lee"), (2, "ann lee"), (3, "Bob Stone"), (4, "Bob Stoner"), (5, "Cy"), (6, "Bob Stone")]


@pytest.mark.parametrize(
    ("query", "status", "player"),
    [
        ("Ann Lee", "exact", 1),
        ("Bob Stone", "exact", 6),
        ("  BOB STONE ", "ci", 6),
        ("ANN LEE", "ci", 2),
        ("stoner", "substring", 4),
        ("y", "substring", 5),
        ("sto", "ambiguous", None),
        ("zzz", "not_found", None),
        ("", "empty", None),
        (None, "empty", None),
        ("  ", "ambiguous", None),
    ],
)
def test_resolve_names(spark, query, status, player):
    dim = spark.createDataFrame(NAMES, "id long, full_name string")
    row = players.resolve_names(spark.createDataFrame([(query,)], "query string"), dim).first()
    assert (row.status, row.player_id) == (status, player)
    if query == "sto":
        assert row.candidates == "Bob Stone, Bob Stoner"
    if query == "  ":
        assert row.candidates == ", ".join(sorted({name for _, name in NAMES})[:5])


def test_resolve_names_lists_five_of_many(spark):
    dim = spark.range(400).selectExpr("id", "concat('Player ', lpad(id, 4, '0')) as full_name")
    row = players.resolve_names(spark.createDataFrame([("LAYER 00",), ("",)], "query string"), dim).collect()
    assert {r.query: r.status for r in row} == {"LAYER 00": "ambiguous", "": "empty"}
    assert next(r for r in row if r.query).candidates == ", ".join(f"Player {i:04d}" for i in range(5))


def test_players_with_games(spark):
    log = spark.createDataFrame([("7", "Ann"), ("7", "Ann"), ("x", "No"), ("8", None)], "PLAYER_ID string, PLAYER_NAME string")
    assert sorted(map(tuple, players.players_with_games(log).collect())) == [(7, "Ann"), (8, "Unknown")]


def test_season_export(spark, scored_rows, tmp_path):
    from shotmetrics.plans.exports import export_season
    from shotmetrics.schema import SHOT_COLUMNS

    paths = export_season(scored_rows, str(tmp_path / "out"), 1997)
    back = spark.read.option("header", True).csv(paths["shots"])
    assert back.columns == [*SHOT_COLUMNS, "p_make", "made_minus_expected", "is_3", "zone_id"]
    assert back.count() == scored_rows.where("season = '1997-98' and season_type = 'Regular Season'").count()
    assert spark.read.option("header", True).csv(paths["leaderboard"]).count() == 25


def test_append_writes_few_files(spark, store, scored_rows):
    store.upsert(scored_rows.drop("shot_id", "p_make"))
    stored = store.shots()
    files = stored.select(F.input_file_name()).distinct().count()
    assert files == stored.select("season", "season_type").distinct().count()
    assert stored.select("shot_id").distinct().count() == stored.count() == scored_rows.count()


def test_present_and_missing_players(spark):
    stored = frame(spark, [shot(i) for i in range(20)] + [shot(1, player=8, season="2024-25")])
    asked = spark.createDataFrame([(7, SEASON, "Regular Season"), (8, SEASON, "Regular Season")], "player_id long, season string, season_type string")
    assert [r.player_id for r in tables.present_players(asked, stored).collect()] == [7]
    assert [r.player_id for r in tables.missing_players(asked, stored).collect()] == [8]
