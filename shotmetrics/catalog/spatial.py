"""Zones, hexagons, location buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import court
from ..operators import spatial
from ..operators.features import with_made_minus_expected
from .base import FG, XFG, fixture_sql, query, rounded_sql, scored, stored_once


def _rows(spark, sf_dir):
    return with_made_minus_expected(scored(spark, sf_dir))


_ANGLE = "degrees(atan2(abs(loc_y), loc_x))"
ZONE_SQL = f"""CASE
    WHEN loc_x < -250 OR loc_x > 250 OR loc_y < -47.5 OR loc_y > 422.5 THEN NULL
    WHEN loc_y <= 140 AND loc_x <= -220 THEN 'corner3_left'
    WHEN loc_y <= 140 AND loc_x >= 220 THEN 'corner3_right'
    WHEN sqrt(loc_x * loc_x + loc_y * loc_y) <= 80 THEN 'restricted'
    WHEN loc_y <= 190 AND abs(loc_x) <= 80 THEN
      CASE WHEN loc_x < -26.67 THEN 'paint_left' WHEN loc_x > 26.67 THEN 'paint_right' ELSE 'paint_center' END
    WHEN sqrt(loc_x * loc_x + loc_y * loc_y) <= 237.5 THEN
      CASE WHEN {_ANGLE} >= 140 THEN 'mid_left' WHEN {_ANGLE} >= 110 THEN 'mid_left_center'
           WHEN {_ANGLE} >= 70 THEN 'mid_center' WHEN {_ANGLE} >= 40 THEN 'mid_right_center' ELSE 'mid_right' END
    WHEN {_ANGLE} >= 120 THEN 'three_left' WHEN {_ANGLE} >= 60 THEN 'three_center' ELSE 'three_right' END"""

_ZONED = f"""{fixture_sql()}, zoned AS (
  SELECT *, {ZONE_SQL} AS zone_id, shot_made_flag - p_make AS made_minus_expected FROM scored)"""
# mean of made minus expected, as one sum
_SMOE = "(CAST(sum(10000 * shot_made_flag - p4) AS DOUBLE) / (count(*) * 10000))"


@query("court_zones", f"{_ZONED} SELECT shot_id, loc_x, loc_y, zone_id FROM zoned")
def court_zones(spark, sf_dir):
    return spatial.with_zone(scored(spark, sf_dir)).select("shot_id", "loc_x", "loc_y", "zone_id")


@query(
    "zone_frequency",
    f"""{_ZONED} SELECT season, season_type, zone_id, count(*) AS attempts, CAST(count(*) AS DOUBLE) AS value
FROM zoned WHERE zone_id IS NOT NULL GROUP BY 1, 2, 3""",
)
def zone_frequency(spark, sf_dir):
    return spatial.zone_map(_rows(spark, sf_dir), "frequency", by=["season", "season_type"])


@query(
    "zone_quality",
    f"""{_ZONED} SELECT player_id, season, zone_id, count(*) AS attempts, {XFG} AS value
FROM zoned WHERE zone_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 6""",
)
def zone_quality(spark, sf_dir):
    return spatial.zone_map(_rows(spark, sf_dir), "quality", by=["player_id", "season"])


@query(
    "zone_smoe",
    f"""{_ZONED} SELECT player_id, season, zone_id, count(*) AS attempts, {_SMOE} AS value
FROM zoned WHERE zone_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 6""",
)
def zone_smoe(spark, sf_dir):
    return spatial.zone_map(_rows(spark, sf_dir), "smoe", by=["player_id", "season"])


_NAMES = ", ".join(f"'{z}'" for z in court.ZONE_NAMES)


@query(
    "zone_map_full",
    f"""{_ZONED}, vals AS (
  SELECT player_id, season, zone_id, count(*) AS attempts, {XFG} AS value
  FROM zoned WHERE zone_id IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) >= 6
), frames AS (
  SELECT player_id, season, unnest([{_NAMES}]) AS zone_id FROM (SELECT DISTINCT player_id, season FROM vals))
SELECT f.player_id, f.season, f.zone_id, v.attempts, v.value FROM frames f LEFT JOIN vals v
  ON v.player_id = f.player_id AND v.season = f.season AND v.zone_id = f.zone_id""",
)
def zone_map_full(spark, sf_dir):
    by = ["player_id", "season"]
    return spatial.every_zone(spatial.zone_map(_rows(spark, sf_dir), "quality", by=by), by=by)


@query(
    "value_range",
    f"""{_ZONED}, smoe AS (
  SELECT {_SMOE} AS value FROM zoned WHERE zone_id IS NOT NULL GROUP BY zone_id HAVING count(*) >= 6
), quantity AS (
  SELECT CAST(count(*) AS DOUBLE) AS value FROM zoned WHERE zone_id IS NOT NULL GROUP BY zone_id
), a AS (SELECT min(value) AS lo, max(value) AS hi FROM smoe), b AS (SELECT min(value) AS lo, max(value) AS hi FROM quantity)
SELECT 'smoe' AS map, -greatest(abs(lo), abs(hi), 1e-6) AS vmin, greatest(abs(lo), abs(hi), 1e-6) AS vmax FROM a
UNION ALL
SELECT 'frequency', lo, CASE WHEN abs(lo - hi) <= 1e-8 + 1e-5 * abs(hi) THEN lo + 1e-6 ELSE hi END FROM b""",
)
def value_range(spark, sf_dir):
    # one pass over the shots; both maps come from the zone sums
    zones = stored_once(spatial.zone_map(_rows(spark, sf_dir), "smoe"))
    smoe = spatial.value_range(zones, center_zero=True)
    counts = spatial.value_range(zones.withColumn("value", F.col("attempts").cast("double")))
    named = smoe.select(F.lit("smoe").alias("map"), "*").unionByName(counts.select(F.lit("frequency").alias("map"), "*"))
    return named


_PAD = "5e-7"
_HEX = f"""{fixture_sql()}, grid AS (
  SELECT *, (loc_x - (-250 - {_PAD})) / ((250 + {_PAD} - (-250 - {_PAD})) / 34) AS u,
    (loc_y - (-47.5::DOUBLE)) / (470.0::DOUBLE / 19) AS v FROM scored
), near AS (
  SELECT *, round_even(u, 0) AS ai, round_even(v, 0) AS aj, floor(u) AS bi, floor(v) AS bj FROM grid
), picked AS (
  SELECT *, (u - ai) * (u - ai) + 3.0::DOUBLE * (v - aj) * (v - aj)
    < (u - bi - 0.5::DOUBLE) * (u - bi - 0.5::DOUBLE)
      + 3.0::DOUBLE * (v - bj - 0.5::DOUBLE) * (v - bj - 0.5::DOUBLE) AS on_a FROM near
), cells AS (
  SELECT *, CASE WHEN on_a THEN 'A' ELSE 'B' END AS lattice, CAST(CASE WHEN on_a THEN ai ELSE bi END AS INTEGER) AS i,
    CAST(CASE WHEN on_a THEN aj ELSE bj END AS INTEGER) AS j FROM picked
  WHERE CASE WHEN on_a THEN ai BETWEEN 0 AND 34 AND aj BETWEEN 0 AND 19
             ELSE bi BETWEEN 0 AND 33 AND bj BETWEEN 0 AND 18 END
)"""
_CENTER = f"""(i + CASE WHEN lattice = 'B' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END)
    * ((250 + {_PAD} - (-250 - {_PAD})) / 34) + (-250 - {_PAD}) AS hex_x,
  (j + CASE WHEN lattice = 'B' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) * (470.0::DOUBLE / 19) + (-47.5::DOUBLE) AS hex_y"""


@query(
    "hex_frequency",
    f"{_HEX} SELECT season, lattice, i, j, count(*) AS attempts, {_CENTER} FROM cells GROUP BY 1, 2, 3, 4",
)
def hex_frequency(spark, sf_dir):
    return spatial.hex_map(_rows(spark, sf_dir), by=["season"])


@query(
    "hex_quality",
    f"{_HEX} SELECT lattice, i, j, count(*) AS attempts, {XFG} AS value, {_CENTER} FROM cells GROUP BY 1, 2, 3",
)
def hex_quality(spark, sf_dir):
    return spatial.hex_map(_rows(spark, sf_dir), "p_make")


@query(
    "hex_smoe",
    f"{_HEX} SELECT lattice, i, j, count(*) AS attempts, {_SMOE} AS value, {_CENTER} FROM cells GROUP BY 1, 2, 3",
)
def hex_smoe(spark, sf_dir):
    return spatial.hex_map(_rows(spark, sf_dir), "made_minus_expected")


_DEG = "degrees(atan2(loc_y, loc_x))"
_BUCKETS = f"""{fixture_sql()}, placed AS (
  SELECT *, CASE WHEN shot_distance < 0 THEN NULL WHEN shot_distance < 8 THEN '0-8 ft' WHEN shot_distance < 16 THEN '8-16 ft'
      WHEN shot_distance < 24 THEN '16-24 ft' WHEN shot_distance < 35 THEN '24-35 ft'
      WHEN shot_distance < 100 THEN '35+ ft' END AS distance_bucket,
    CASE WHEN {_DEG} < -181 THEN NULL WHEN {_DEG} <= -120 THEN 'Far Left' WHEN {_DEG} <= -60 THEN 'Left Wing'
      WHEN {_DEG} <= -20 THEN 'Left' WHEN {_DEG} <= 20 THEN 'Center' WHEN {_DEG} <= 60 THEN 'Right'
      WHEN {_DEG} <= 120 THEN 'Right Wing' WHEN {_DEG} <= 181 THEN 'Far Right' END AS angle_bucket
  FROM scored
), found AS (
  SELECT distance_bucket, angle_bucket, count(*) AS n, {FG} AS fg, {XFG} AS xfg FROM placed GROUP BY 1, 2
), pairs AS (
  SELECT distance_bucket, unnest(['Far Left', 'Left Wing', 'Left', 'Center', 'Right', 'Right Wing', 'Far Right']) AS angle_bucket
  FROM (SELECT unnest(['0-8 ft', '8-16 ft', '16-24 ft', '24-35 ft', '35+ ft']) AS distance_bucket)
), buckets AS (
  SELECT p.distance_bucket, p.angle_bucket, p.distance_bucket || ' | ' || p.angle_bucket AS location,
    coalesce(n, 0) AS attempts, fg * 100 AS fg_pct, xfg * 100 AS xfg_pct, (fg - xfg) * 100 AS smoe
  FROM pairs p LEFT JOIN found f ON f.distance_bucket = p.distance_bucket AND f.angle_bucket = p.angle_bucket
)"""


@query("location_buckets", f"{_BUCKETS} SELECT * FROM buckets")
def location_buckets(spark, sf_dir):
    return spatial.location_buckets(scored(spark, sf_dir), min_attempts=0)


def _spot(order: str, segment: str) -> str:
    figures = ", ".join(f"{rounded_sql(c, 1)} AS {c}" for c in ("fg_pct", "xfg_pct", "smoe"))
    return f"""SELECT * FROM (SELECT '{segment}' AS segment, location, attempts, {figures}
  FROM buckets WHERE attempts >= 15 ORDER BY buckets.smoe {order}, location LIMIT 5)"""


@query("best_worst_spots", f"{_BUCKETS} {_spot('DESC', 'Best Spots')} UNION ALL {_spot('ASC', 'Worst Spots')}")
def best_worst_spots(spark, sf_dir):
    return spatial.best_and_worst(spatial.location_buckets(scored(spark, sf_dir)))
