"""Court geometry and shot classification as column expressions.

Coordinates are tenths of a foot with the rim at the origin, x to the
shooter's right and y towards midcourt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import THREE_POINT_TYPE
from .numeric import lenient_double, text_or

# Court bounds, zone names and bucket edges.
X_MIN, X_MAX = -250.0, 250.0
Y_MIN, Y_MAX = -47.5, 422.5
ZONE_NAMES = [
    "corner3_left",
    "corner3_right",
    "restricted",
    "paint_left",
    "paint_center",
    "paint_right",
    "mid_right",
    "mid_right_center",
    "mid_center",
    "mid_left_center",
    "mid_left",
    "three_right",
    "three_center",
    "three_left",
]
DISTANCE_EDGES = [0, 8, 16, 24, 35, 100]
DISTANCE_LABELS = ["0-8 ft", "8-16 ft", "16-24 ft", "24-35 ft", "35+ ft"]
ANGLE_EDGES = [-181, -120, -60, -20, 20, 60, 120, 181]
ANGLE_LABELS = ["Far Left", "Left Wing", "Left", "Center", "Right", "Right Wing", "Far Right"]
THREE_POINT_ZONES = ["Above the Break 3", "Backcourt", "Left Corner 3", "Right Corner 3"]
PAINT_ZONES = ["Restricted Area", "In The Paint (Non-RA)"]

HEX_COLUMNS = 34
HEX_ROWS = int(HEX_COLUMNS / 3**0.5)
# the x range is widened a touch so that no hexagon centre falls on its edge
_HEX_PAD = 1e-9 * (X_MAX - X_MIN)
HEX_X0 = X_MIN - _HEX_PAD
HEX_DX = (X_MAX + _HEX_PAD - HEX_X0) / HEX_COLUMNS
HEX_Y0 = Y_MIN
HEX_DY = (Y_MAX - Y_MIN) / HEX_ROWS


def radius(x: Column, y: Column) -> Column:
    return F.sqrt(x * x + y * y)


def floor_angle(x: Column, y: Column) -> Column:
    """Degrees from the right baseline, points behind the rim mirrored to the front."""
    return F.degrees(F.atan2(F.abs(y), x))


def zone_id(x: Column, y: Column, r: Column | None = None, theta: Column | None = None) -> Column:
    """One of the 14 court zones; null outside the half court or without coordinates.

    Distance and angle may be given as columns of an earlier projection, which
    then computes them once for all comparisons.
    """
    inside = (x >= X_MIN) & (x <= X_MAX) & (y >= Y_MIN) & (y <= Y_MAX)
    r = radius(x, y) if r is None else r
    theta = floor_angle(x, y) if theta is None else theta
    third = 26.67

    def by_angle(steps: list[tuple[float, str]], last: str) -> Column:
        (first_bound, first_name), *rest = steps
        chain = F.when(theta >= first_bound, first_name)
        for bound, name in rest:
            chain = chain.when(theta >= bound, name)
        return chain.otherwise(last)

    paint = F.when(x < -third, "paint_left").when(x > third, "paint_right").otherwise("paint_center")
    mid = by_angle(
        [(140, "mid_left"), (110, "mid_left_center"), (70, "mid_center"), (40, "mid_right_center")],
        "mid_right",
    )
    three = by_angle([(120, "three_left"), (60, "three_center")], "three_right")
    zone = (
        F.when((y <= 140) & (x <= -220), "corner3_left")
        .when((y <= 140) & (x >= 220), "corner3_right")
        .when(r <= 80, "restricted")
        .when((y <= 190) & (F.abs(x) <= 80), paint)
        .when(r <= 237.5, mid)
        .otherwise(three)
    )
    return F.when(inside, zone)


def hex_grid(x: Column, y: Column) -> tuple[Column, Column]:
    """Court coordinates in units of the hexagon lattice."""
    return (x - F.lit(HEX_X0)) / F.lit(HEX_DX), (y - F.lit(HEX_Y0)) / F.lit(HEX_DY)


def with_hex_cell(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Add lattice, i, j of the hexagon a point falls in; null off the grid.

    Two offset rectangular lattices cover the court; the nearer centre wins.
    Each step is a projection of its own, so nothing is computed twice.
    """
    u, v = hex_grid(x, y)
    df = df.withColumns({"_u": u, "_v": v})
    u, v = F.col("_u"), F.col("_v")
    df = df.withColumns({"_ai": F.rint(u), "_aj": F.rint(v), "_bi": F.floor(u).cast("double"), "_bj": F.floor(v).cast("double")})
    ai, aj, bi, bj = (F.col(c) for c in ("_ai", "_aj", "_bi", "_bj"))
    to_a = (u - ai) * (u - ai) + F.lit(3.0) * (v - aj) * (v - aj)
    du, dv = u - bi - F.lit(0.5), v - bj - F.lit(0.5)
    to_b = du * du + F.lit(3.0) * dv * dv
    df = df.withColumn("_near_a", to_a < to_b)
    on_a = (ai >= 0) & (ai <= HEX_COLUMNS) & (aj >= 0) & (aj <= HEX_ROWS)
    on_b = (bi >= 0) & (bi <= HEX_COLUMNS - 1) & (bj >= 0) & (bj <= HEX_ROWS - 1)
    near_a = F.col("_near_a")
    df = df.withColumn("lattice", F.when(near_a & on_a, "A").when(~near_a & on_b, "B"))
    placed = F.col("lattice")
    return df.withColumns(
        {
            "i": F.when(placed == "A", ai).when(placed == "B", bi).cast("int"),
            "j": F.when(placed == "A", aj).when(placed == "B", bj).cast("int"),
        }
    ).drop("_u", "_v", "_ai", "_aj", "_bi", "_bj", "_near_a")


def hex_center(lattice: Column, i: Column, j: Column) -> tuple[Column, Column]:
    """Court coordinates of a cell's centre."""
    shift = F.when(lattice == "B", 0.5).otherwise(0.0)
    return (
        (i.cast("double") + shift) * F.lit(HEX_DX) + F.lit(HEX_X0),
        (j.cast("double") + shift) * F.lit(HEX_DY) + F.lit(HEX_Y0),
    )


def distance_bucket(feet: Column) -> Column:
    """[0,8) [8,16) [16,24) [24,35) [35,100); null outside."""
    chain = F.when(feet < DISTANCE_EDGES[0], None)
    for upper, label in zip(DISTANCE_EDGES[1:], DISTANCE_LABELS, strict=True):
        chain = chain.when(feet < upper, label)
    return chain


def angle_bucket(degrees: Column) -> Column:
    """Seven bins closed on the right, the first closed on both sides; null outside."""
    chain = F.when(degrees < ANGLE_EDGES[0], None)
    for upper, label in zip(ANGLE_EDGES[1:], ANGLE_LABELS, strict=True):
        chain = chain.when(degrees <= upper, label)
    return chain


def distance_cohort(feet: Column) -> Column:
    """Four distance cohorts; an unknown distance counts as long range."""
    return F.when(feet <= 5, "at_rim").when(feet <= 10, "short_mid").when(feet <= 18, "mid_range").otherwise("long_range")


def angle_cohort(area: Column) -> Column:
    """Side of the floor from the zone area's name, ignoring case in the sides."""
    return (
        F.when(area.isin("Center(C)"), "straight_on")
        .when(area.ilike("%Left%"), "left_side")
        .when(area.ilike("%Right%"), "right_side")
        .otherwise("other")
    )


def is_three_by_zone(zone: Column) -> Column:
    return zone.isin(*THREE_POINT_ZONES)


def is_three_by_type(shot_type: Column) -> Column:
    return shot_type == THREE_POINT_TYPE


def is_paint(zone: Column) -> Column:
    return zone.isin(*PAINT_ZONES)


def points(shot_type: Column, amount: Column) -> Column:
    """Points for a made flag, or expected points for a probability."""
    return F.when(is_three_by_type(shot_type), 3.0).otherwise(2.0) * amount


# A three by geometry, as the original infers it. Corner: at least 22 feet, loc_y at most 140 and
# |loc_x| at least 220 (tenths of a foot); elsewhere at least 23.75 feet. Texts: "3pt" in the type, "3" in the
# basic zone, "24+" in the range.
CORNER_FEET, CORNER_MAX_Y, CORNER_MIN_X, ARC_FEET = 22, 140, 220, 23.75


def inferred_three(df: DataFrame) -> Column:
    """1 when anything known about the shot says it was a three, else 0.

    Type text, zone text and range text are tried beside the geometry, so that
    a dump lacking some of these columns still gets a flag.
    """
    feet = lenient_double(df, "shot_distance")
    x, y = lenient_double(df, "loc_x"), lenient_double(df, "loc_y")
    signs = [
        F.lower(text_or(df, "shot_type")).contains("3pt"),
        text_or(df, "shot_zone_basic").contains("3"),
        text_or(df, "shot_zone_range").contains("24+"),
        (feet >= CORNER_FEET) & (y <= CORNER_MAX_Y) & (F.abs(x) >= CORNER_MIN_X),
        feet >= ARC_FEET,
    ]
    flag = F.coalesce(signs[0], F.lit(False))
    for s in signs[1:]:
        flag = flag | F.coalesce(s, F.lit(False))
    return flag.cast("int")

