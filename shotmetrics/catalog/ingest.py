"""Conforming, inserting, scanning, players."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import null_nan
from ..operators.players import player_names, players_with_games, resolve_names
from ..plans.ingest import first_players
from ..sources import tables
from ..sources.landing import standardize
from ..sources.star_schema import shots, table, with_closed_form_score
from .base import fixture_sql, query, stored_once

# A raw dump made of the order lines: upper-case names, everything text, and
# some values as a careless exporter would write them.
_RAW_SQL = """raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS game_id, l_linenumber AS event,
    CASE WHEN l_tax = 0.0 THEN 'n/a' ELSE ' ' || CAST(l_linenumber AS VARCHAR) || ' ' END AS event_text,
    CASE WHEN l_discount = 0.1 THEN NULL ELSE CAST(l_partkey % 501 - 250 AS VARCHAR) END AS x_text,
    CAST(l_suppkey % 331 - 47 AS VARCHAR) || '.5' AS y_text,
    CASE WHEN l_returnflag = 'A' THEN '1' WHEN l_returnflag = 'N' THEN '0' ELSE 'missing' END AS flag_text,
    CASE WHEN l_linestatus = 'O' THEN strftime(l_shipdate, '%Y-%m-%d')
         WHEN l_quantity > 25 THEN strftime(l_shipdate, '%Y%m%d') ELSE 'soon' END AS date_text,
    l_shipdate, l_linestatus, l_quantity, l_suppkey FROM lineitem)"""


def _text(name):
    return F.col(name).cast("string")


def _raw(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    return items.select(
        _text("l_orderkey").alias("GAME_ID"),
        F.when(F.col("l_tax") == 0.0, "n/a").otherwise(F.concat(F.lit(" "), _text("l_linenumber"), F.lit(" "))).alias("GAME_EVENT_ID"),
        F.when(F.col("l_discount") != 0.1, (F.col("l_partkey") % 501 - 250).cast("string")).alias("LOC_X"),
        F.concat((F.col("l_suppkey") % 331 - 47).cast("string"), F.lit(".5")).alias("LOC_Y"),
        F.when(F.col("l_returnflag") == "A", "1").when(F.col("l_returnflag") == "N", "0").otherwise("missing").alias("SHOT_MADE_FLAG"),
        F.when(F.col("l_linestatus") == "O", F.date_format("l_shipdate", "yyyy-MM-dd"))
        .when(F.col("l_quantity") > 25, F.date_format("l_shipdate", "yyyyMMdd"))
        .otherwise("soon").alias("GAME_DATE"),
        F.lit("not a number").alias("PLAYER_ID"),
        F.lit("ignored").alias("PLAYER_NAME"),
        _text("l_suppkey").alias("SUPPLIER"),
    )


@query(
    "conform_raw",
    f"""WITH {_RAW_SQL}
SELECT '1998-99' AS season, 'Regular Season' AS season_type, l_suppkey AS player_id, 'Player ' || l_suppkey AS player_name,
  CAST(NULL AS BIGINT) AS team_id, CAST(NULL AS VARCHAR) AS team_name, game_id,
  CASE WHEN event_text = 'n/a' THEN NULL ELSE CAST(event AS BIGINT) END AS game_event_id,
  CASE WHEN date_text = 'soon' THEN NULL ELSE CAST(l_shipdate AS DATE) END AS game_date,
  TRY_CAST(x_text AS DOUBLE) AS loc_x, TRY_CAST(y_text AS DOUBLE) AS loc_y,
  CASE WHEN flag_text = '1' THEN 1 ELSE 0 END AS shot_made_flag, CAST(NULL AS DOUBLE) AS shot_distance,
  CAST(NULL AS VARCHAR) AS shot_type, CAST(NULL AS VARCHAR) AS action_type, CAST(NULL AS VARCHAR) AS shot_zone_basic,
  CAST(NULL AS VARCHAR) AS shot_zone_area, CAST(NULL AS VARCHAR) AS shot_zone_range
FROM raw""",
)
def conform_raw(spark, sf_dir):
    player = F.col("SUPPLIER").cast("bigint")
    name = F.concat(F.lit("Player "), F.col("SUPPLIER"))
    return standardize(_raw(spark, sf_dir), "1998-99", "Regular Season", player, name)


@query(
    "clean_nan",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  CASE WHEN l_discount = 0 THEN NULL ELSE l_tax / l_discount END AS ratio FROM lineitem""",
)
def clean_nan(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.try_divide("l_tax", "l_discount"))
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    return null_nan(items.select(*keys, ratio.alias("ratio")))


@query(
    "players_with_games",
    """SELECT DISTINCT c_custkey AS player_id, CASE WHEN c_acctbal < 0 THEN 'Unknown' ELSE c_name END AS player_name
FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority <> '5-LOW'""",
)
def players_with_games_(spark, sf_dir):
    log = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority"), "c_custkey"
    )
    raw = log.select(
        F.when(F.col("o_orderpriority") == "5-LOW", "unreadable").otherwise(F.col("c_custkey").cast("string")).alias("PLAYER_ID"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("PLAYER_NAME"),
    )
    return players_with_games(raw)


# Games before this day count as stored already.
_CUT = "1999-01-01"
# an event number past this one is lost by the exporter, so such rows have no full key
_LAST_EVENT = 6


def _incoming(rows):
    """Every shot twice, some without an event number, those under the basket without a place."""
    lost = rows.withColumns(
        {
            "game_event_id": F.when(F.col("game_event_id") <= _LAST_EVENT, F.col("game_event_id")),
            "loc_x": F.when(F.col("shot_distance") > 0, F.col("loc_x")),
        }
    )
    return lost.unionByName(lost)


def _stored(rows):
    return rows.where(F.col("game_date") < _CUT)


@query(
    "upsert_new_rows",
    f"""{fixture_sql()}, incoming AS (
  SELECT season, season_type, player_id, player_name, game_id,
    CASE WHEN game_event_id <= {_LAST_EVENT} THEN game_event_id END AS game_event_id, game_date,
    CASE WHEN shot_distance > 0 THEN loc_x END AS loc_x, loc_y, shot_made_flag, shot_distance, shot_type FROM shots
), twice AS (SELECT * FROM incoming UNION ALL SELECT * FROM incoming)
SELECT * FROM twice WHERE loc_x IS NOT NULL AND game_event_id IS NULL
UNION ALL
SELECT DISTINCT * FROM twice t WHERE loc_x IS NOT NULL AND game_event_id IS NOT NULL AND NOT EXISTS (
  SELECT 1 FROM shots s WHERE s.game_date < DATE '{_CUT}' AND s.season = t.season AND s.season_type = t.season_type
    AND s.player_id = t.player_id AND s.game_id = t.game_id AND s.game_event_id = t.game_event_id
    AND s.loc_x = t.loc_x AND s.loc_y = t.loc_y AND s.shot_made_flag = t.shot_made_flag)""",
)
def upsert_new_rows(spark, sf_dir):
    rows = stored_once(shots(spark, sf_dir))
    return tables.new_rows(_incoming(rows), _stored(rows)).select(
        "season", "season_type", "player_id", "player_name", "game_id", "game_event_id", "game_date",
        "loc_x", "loc_y", "shot_made_flag", "shot_distance", "shot_type",
    )


@query(
    "unscored_shots",
    f"""{fixture_sql()}
SELECT shot_id, season, season_type, player_id, game_date, p_make AS predicted_make_prob, shot_made_flag AS actual_make
FROM scored WHERE NOT (game_date < DATE '{_CUT}')""",
)
def unscored_shots(spark, sf_dir):
    rows = shots(spark, sf_dir)
    known = tables.as_predictions(with_closed_form_score(_stored(rows)))
    return tables.as_predictions(with_closed_form_score(tables.unscored(rows, known)))


_PLAYERS = "SELECT DISTINCT player_id, player_name, season, season_type FROM shots"
_HAVE = f"""SELECT 1 FROM shots s WHERE s.game_date < DATE '{_CUT}' AND s.player_id = p.player_id
  AND s.season = p.season AND s.season_type = p.season_type"""


def _players(rows):
    return rows.select("player_id", "player_name", "season", "season_type").distinct()


@query("missing_players", f"{fixture_sql('supplier')} SELECT * FROM ({_PLAYERS}) p WHERE NOT EXISTS ({_HAVE})")
def missing_players(spark, sf_dir):
    rows = shots(spark, sf_dir, "supplier")
    return tables.missing_players(_players(rows), _stored(rows))


@query("present_players", f"{fixture_sql('supplier')} SELECT * FROM ({_PLAYERS}) p WHERE EXISTS ({_HAVE})")
def present_players(spark, sf_dir):
    rows = shots(spark, sf_dir, "supplier")
    return tables.present_players(_players(rows), _stored(rows))


@query(
    "first_players",
    f"{fixture_sql('supplier')} SELECT * FROM ({_PLAYERS}) ORDER BY player_name, player_id, season, season_type LIMIT 40",
)
def first_players_(spark, sf_dir):
    players = _players(shots(spark, sf_dir, "supplier"))
    return first_players(players, 40, order=["player_name", "player_id", "season", "season_type"])


@query("season_counts", f"{fixture_sql()} SELECT season, season_type, count(*) AS n_shots FROM shots GROUP BY 1, 2")
def season_counts(spark, sf_dir):
    return tables.season_counts(shots(spark, sf_dir))


_SCAN = """SELECT shot_id, player_id, game_id, game_event_id, game_date, loc_x, loc_y, shot_made_flag, shot_distance,
  shot_type, shot_zone_basic, shot_zone_area, shot_zone_range FROM shots"""
_SCAN_COLUMNS = [
    "shot_id", "player_id", "game_id", "game_event_id", "game_date", "loc_x", "loc_y", "shot_made_flag",
    "shot_distance", "shot_type", "shot_zone_basic", "shot_zone_area", "shot_zone_range",
]


@query("season_scan", f"{fixture_sql()} {_SCAN} WHERE season = '1997-98' AND season_type = 'Regular Season'")
def season_scan(spark, sf_dir):
    return tables.season_shots(shots(spark, sf_dir), "1997-98").select(*_SCAN_COLUMNS)


@query(
    "player_scan",
    f"{fixture_sql()} {_SCAN} WHERE player_id = 7 AND season = '1997-98' AND season_type = 'Regular Season'",
)
def player_scan(spark, sf_dir):
    return tables.player_shots(shots(spark, sf_dir), 7, "1997-98").select(*_SCAN_COLUMNS)


@query("player_names", "SELECT c_name AS full_name FROM customer WHERE c_acctbal > 0")
def player_names_(spark, sf_dir):
    dim = table(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name"), (F.col("c_acctbal") > 0).alias("is_active"))
    return player_names(dim, active_only=True)


# Every customer asks for a name: as stored, in capitals, by its last digits,
# by a leading part, or wrongly, depending on the market segment.
_ASKED_SQL = """asked AS (
  SELECT DISTINCT CASE c_mktsegment WHEN 'AUTOMOBILE' THEN c_name WHEN 'BUILDING' THEN '  ' || upper(c_name)
    WHEN 'FURNITURE' THEN right(c_name, 5) WHEN 'HOUSEHOLD' THEN left(c_name, 16) ELSE 'Nobody ' || right(c_name, 3)
    END AS query FROM customer)"""


@query(
    "resolve_names",
    f"""WITH {_ASKED_SQL}, hits AS (
  SELECT a.query, c.c_name, c.c_custkey,
    row_number() OVER (PARTITION BY a.query ORDER BY c.c_name) AS place, count(*) OVER (PARTITION BY a.query) AS n
  FROM asked a JOIN customer c ON contains(lower(c.c_name), lower(trim(a.query)))
), best AS (
  SELECT a.query, max(e.c_custkey) AS exact_id, max(f.c_custkey) AS ci_id
  FROM asked a LEFT JOIN customer e ON e.c_name = a.query LEFT JOIN customer f ON lower(f.c_name) = lower(trim(a.query))
  GROUP BY 1
), subs AS (
  SELECT query, max(n) AS n, max(c_custkey) AS id, string_agg(c_name, ', ' ORDER BY c_name) AS names
  FROM hits WHERE place <= 5 GROUP BY 1)
SELECT b.query,
  CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN ci_id IS NOT NULL THEN 'ci' WHEN n = 1 THEN 'substring'
       WHEN n > 1 THEN 'ambiguous' ELSE 'not_found' END AS status,
  coalesce(exact_id, ci_id, CASE WHEN n = 1 THEN id END) AS player_id,
  CASE WHEN exact_id IS NULL AND ci_id IS NULL AND n > 1 THEN names END AS candidates
FROM best b LEFT JOIN subs s ON s.query = b.query""",
)
def resolve_names_(spark, sf_dir):
    people = table(spark, sf_dir, "customer")
    name = F.col("c_name")
    asked = (
        F.when(F.col("c_mktsegment") == "AUTOMOBILE", name)
        .when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("  "), F.upper(name)))
        .when(F.col("c_mktsegment") == "FURNITURE", F.right(name, F.lit(5)))
        .when(F.col("c_mktsegment") == "HOUSEHOLD", F.left(name, F.lit(16)))
        .otherwise(F.concat(F.lit("Nobody "), F.right(name, F.lit(3))))
    )
    dim = people.select(F.col("c_custkey").alias("id"), name.alias("full_name"))
    return resolve_names(people.select(asked.alias("query")), dim)
