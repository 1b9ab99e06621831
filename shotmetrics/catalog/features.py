"""Features, flags, seasons, model matrix, split."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import court, seasons
from ..functions.numeric import round_half_away
from ..operators import features
from ..plans.exports import shot_extract
from ..sources.star_schema import shots, table
from .base import fixture_sql, query, rounded_sql, scored
from .spatial import ZONE_SQL

_THREE = """CASE WHEN shot_type ILIKE '%3pt%' OR shot_zone_basic LIKE '%3%' OR shot_zone_range LIKE '%24+%'
    OR (shot_distance >= 22 AND loc_y <= 140 AND abs(loc_x) >= 220) OR shot_distance >= 23.75 THEN 1 ELSE 0 END"""
_DIST = "sqrt(loc_x * loc_x + loc_y * loc_y)"
_ANG = rounded_sql("atan2(loc_y, loc_x)", 9)


@query(
    "engineered_features",
    f"""{fixture_sql()}
SELECT shot_id, {_DIST} AS distance, {_ANG} AS angle, {_THREE} AS is_3, shot_zone_basic,
  coalesce(shot_zone_area, 'Unknown') AS shot_zone_area, shot_zone_range FROM shots""",
)
def engineered_features(spark, sf_dir):
    feats = features.with_features(shots(spark, sf_dir))
    return feats.select(
        "shot_id", "distance", round_half_away(F.col("angle"), 9).alias("angle"), "is_3",
        "shot_zone_basic", "shot_zone_area", "shot_zone_range",
    )


@query(
    "three_point_flag",
    f"""{fixture_sql()}
SELECT season, shot_type, {_THREE} AS by_any_sign,
  CASE WHEN shot_distance >= 22 AND loc_y <= 140 AND abs(loc_x) >= 220 OR shot_distance >= 23.75 THEN 1 ELSE 0 END
    AS by_geometry,
  CASE WHEN shot_zone_basic IN ('Above the Break 3', 'Backcourt', 'Left Corner 3', 'Right Corner 3') THEN 1 ELSE 0 END
    AS by_zone,
  CASE WHEN shot_type = '3PT Field Goal' THEN 1 ELSE 0 END AS by_type,
  CASE WHEN shot_zone_basic IN ('Restricted Area', 'In The Paint (Non-RA)') THEN 1 ELSE 0 END AS paint,
  count(*) AS n
FROM shots GROUP BY ALL""",
)
def three_point_flag(spark, sf_dir):
    rows = shots(spark, sf_dir)
    bare = rows.select("shot_distance", "loc_x", "loc_y")
    flags = rows.select(
        "season",
        "shot_type",
        court.inferred_three(rows).alias("by_any_sign"),
        court.inferred_three(bare).alias("by_geometry"),
        court.is_three_by_zone(F.col("shot_zone_basic")).cast("int").alias("by_zone"),
        court.is_three_by_type(F.col("shot_type")).cast("int").alias("by_type"),
        court.is_paint(F.col("shot_zone_basic")).cast("int").alias("paint"),
    )
    return flags.groupBy(*flags.columns).agg(F.count(F.lit(1)).alias("n"))


@query(
    "season_labels",
    """SELECT CAST(o_orderdate AS DATE) AS day, strftime(o_orderdate, '%Y-%m') AS month,
  CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS start_year,
  CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) || '-' || right(CAST(year(o_orderdate) + 1 AS VARCHAR), 2)
       ELSE (year(o_orderdate) - 1) || '-' || right(CAST(year(o_orderdate) AS VARCHAR), 2) END AS season,
  count(*) AS games
FROM orders GROUP BY ALL""",
)
def season_labels(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    labelled = days.select(
        "day",
        seasons.month_key(F.col("day")).alias("month"),
        seasons.season_start_year(F.col("day")).alias("start_year"),
        seasons.season_of(F.col("day")).alias("season"),
    )
    return labelled.groupBy("day", "month", "start_year", "season").agg(F.count(F.lit(1)).alias("games"))


@query(
    "season_dim",
    """WITH l AS (SELECT max(CAST(o_orderdate AS DATE)) AS d FROM orders),
y AS (SELECT CASE WHEN month(d) >= 9 THEN year(d) ELSE year(d) - 1 END AS last FROM l)
SELECT CAST(s AS INTEGER) AS start_year, s || '-' || right(CAST(s + 1 AS VARCHAR), 2) AS season, s = last AS is_default
FROM (SELECT last, unnest(generate_series(1996, last)) AS s FROM y)""",
)
def season_dim(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    return seasons.season_options(days.agg(F.max("day").alias("day")))


# the levels that occur in the derived shots
_LEVELS = {
    "shot_zone_basic": [
        "Above the Break 3", "In The Paint (Non-RA)", "Left Corner 3", "Mid-Range", "Restricted Area", "Right Corner 3",
    ],
    "shot_zone_area": ["Center(C)", "Left Side(L)", "Right Side(R)", "Unknown"],
    "shot_zone_range": ["16-24 ft.", "24+ ft.", "8-16 ft.", "Less Than 8 ft."],
}
_ONE_HOT = ",\n  ".join(
    f"CASE WHEN coalesce({c}, 'Unknown') = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, vs in _LEVELS.items() for v in vs
)


@query(
    "model_matrix",
    f"""{fixture_sql()}
SELECT shot_id, loc_x, loc_y, {_DIST} AS distance, {_ANG} AS angle, CAST({_THREE} AS DOUBLE) AS is_3, {_ONE_HOT},
  shot_made_flag AS label FROM shots""",
)
def model_matrix(spark, sf_dir):
    rows = shots(spark, sf_dir)
    matrix = features.model_matrix(rows, features.one_hot_levels(rows), keep=["shot_id"])
    return matrix.withColumn("angle", round_half_away(F.col("angle"), 9))


@query(
    "group_split",
    f"""{fixture_sql()}
SELECT shot_id, game_id, is_test FROM shots JOIN (
  SELECT grp, row_number() OVER (ORDER BY h, grp) <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test FROM (
    SELECT DISTINCT game_id AS grp, CAST('0x' || substr(md5(game_id || '42'), 1, 8) AS BIGINT) AS h FROM shots)) ON game_id = grp""",
)
def group_split(spark, sf_dir):
    return features.with_split(shots(spark, sf_dir)).select("shot_id", "game_id", "is_test")


@query(
    "shot_extract",
    f"""{fixture_sql()}
SELECT season, season_type, player_id, player_name, CAST(NULL AS BIGINT) AS team_id, CAST(NULL AS VARCHAR) AS team_name,
  game_id, game_event_id, game_date, loc_x, loc_y, shot_made_flag, shot_distance, shot_type,
  CAST(NULL AS VARCHAR) AS action_type, shot_zone_basic, shot_zone_area, shot_zone_range, p_make,
  shot_made_flag - p_make AS made_minus_expected, {_THREE} AS is_3, {ZONE_SQL} AS zone_id FROM scored""",
)
def shot_extract_(spark, sf_dir):
    return shot_extract(scored(spark, sf_dir))
