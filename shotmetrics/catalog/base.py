"""Registry, and the SQL twin of the derived shot tables.

A query and its SQL stand side by side. The SQL works on whole numbers (the
probability times 10,000) where it can, so that both engines divide the same
two numbers once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.lineage import checkpointed
from ..operators.reports import join_predictions
from ..sources.star_schema import predictions, shots, with_closed_form_score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def joined(spark: SparkSession, sf_dir: str, players: str = "nation") -> DataFrame:
    """Shots joined with the stored predictions."""
    return join_predictions(shots(spark, sf_dir, players), predictions(spark, sf_dir, players))


def scored(spark: SparkSession, sf_dir: str, players: str = "nation") -> DataFrame:
    """Shots scored on the spot by the closed form."""
    return with_closed_form_score(shots(spark, sf_dir, players))


def stored_once(df: DataFrame) -> DataFrame:
    """Derived rows that a query reads several times, written once in between.

    With real data these are stored tables.
    """
    return checkpointed(df)


def fixture_sql(players: str = "nation") -> str:
    """CTEs shots and predictions; start of a WITH clause."""
    if players == "nation":
        who = "CAST(n_nationkey AS BIGINT) AS player_id, n_name AS player_name"
        whose = "JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey"
    else:
        who = "l_suppkey AS player_id, s_name AS player_name"
        whose = "JOIN supplier ON s_suppkey = l_suppkey"
    return f"""
WITH fx_line AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
               l_returnflag, l_linestatus, l_shipdate) AS copy_no
    FROM lineitem) WHERE copy_no = 1
), fx_base AS (
  SELECT l_orderkey * 8 + l_linenumber AS shot_id, {who},
    CAST(l_orderkey AS VARCHAR) AS game_id, CAST(l_linenumber AS BIGINT) AS game_event_id,
    CAST(o_orderdate AS DATE) AS game_date,
    CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END AS sy,
    CASE WHEN o_orderstatus = 'P' THEN 'Playoffs' ELSE 'Regular Season' END AS season_type,
    (l_partkey * 37 + l_suppkey * 11 + l_orderkey) % 501 - 250 AS x,
    (l_partkey * 53 + l_linenumber * 29 + l_orderkey * 7) % 331 - 47 AS y
  FROM fx_line JOIN orders ON o_orderkey = l_orderkey {whose}
), fx_geo AS (
  SELECT *, CAST(sy AS VARCHAR) || '-' || lpad(CAST((sy + 1) % 100 AS VARCHAR), 2, '0') AS season,
    sqrt(CAST(x * x + y * y AS DOUBLE)) AS r,
    CAST(floor(sqrt(CAST(x * x + y * y AS DOUBLE)) / 10) AS BIGINT) AS feet
  FROM fx_base
), fx_p AS (
  SELECT *, greatest(2000, 6500 - 120 * feet) AS p4 FROM fx_geo
), shots AS (
  SELECT shot_id, season, season_type, player_id, player_name, game_id, game_event_id, game_date, sy,
    CAST(x AS DOUBLE) AS loc_x, CAST(y AS DOUBLE) AS loc_y, x, y,
    CASE WHEN ((shot_id * 2654435761 + 12345) % 1000003) % 10000
              < p4 + ((player_id * 7 + sy * 3) % 11 - 5) * 150 THEN 1 ELSE 0 END AS shot_made_flag,
    CAST(feet AS DOUBLE) AS shot_distance, feet,
    CASE WHEN y <= 92 AND x <= -220 OR y <= 92 AND x >= 220 THEN '3PT Field Goal'
         WHEN r <= 40 OR abs(x) <= 80 AND y <= 142 OR r < 237.5 THEN '2PT Field Goal'
         ELSE '3PT Field Goal' END AS shot_type,
    CASE WHEN y <= 92 AND x <= -220 THEN 'Left Corner 3' WHEN y <= 92 AND x >= 220 THEN 'Right Corner 3'
         WHEN r <= 40 THEN 'Restricted Area' WHEN abs(x) <= 80 AND y <= 142 THEN 'In The Paint (Non-RA)'
         WHEN r < 237.5 THEN 'Mid-Range' ELSE 'Above the Break 3' END AS shot_zone_basic,
    CASE WHEN shot_id % 97 = 0 THEN NULL WHEN abs(x) <= 80 THEN 'Center(C)'
         WHEN x < -80 THEN 'Left Side(L)' ELSE 'Right Side(R)' END AS shot_zone_area,
    CASE WHEN feet < 8 THEN 'Less Than 8 ft.' WHEN feet < 16 THEN '8-16 ft.'
         WHEN feet < 24 THEN '16-24 ft.' ELSE '24+ ft.' END AS shot_zone_range
  FROM fx_p
), predictions AS (
  SELECT shot_id, p4, CAST(p4 AS DOUBLE) / 10000 AS predicted_make_prob FROM fx_p
), scored AS (
  SELECT s.*, p.p4, p.predicted_make_prob AS p_make FROM shots s JOIN predictions p ON p.shot_id = s.shot_id
)"""


def rounded_sql(x: str, digits: int) -> str:
    return f"(sign({x}) * floor(abs({x}) * 1e{digits} + 0.5) / 1e{digits})"


# building blocks of the aggregate SQL
N = "CAST(count(*) AS DOUBLE)"
FG = "(CAST(sum(shot_made_flag) AS DOUBLE) / count(*))"
XFG = "(CAST(sum(p4) AS DOUBLE) / (count(*) * 10000))"
FEET = "(CAST(sum(feet) AS DOUBLE) / count(*))"


def share_sql(condition: str) -> str:
    return f"(CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS DOUBLE) / count(*))"


THREE_ZONE = "shot_zone_basic IN ('Above the Break 3', 'Backcourt', 'Left Corner 3', 'Right Corner 3')"
THREE_TYPE = "shot_type = '3PT Field Goal'"
PAINT = "shot_zone_basic IN ('Restricted Area', 'In The Paint (Non-RA)')"


def units_sql(x: str, unit: str = "1e9") -> str:
    """A double as a whole number of small units, summed without rounding error."""
    return f"CAST(round_even(({x}) * {unit}, 0) AS BIGINT)"


def exact_mean_sql(x: str, unit: str = "1e9") -> str:
    return f"(CAST(sum({units_sql(x, unit)}) AS DOUBLE) / (count({x}) * {unit}))"
