"""Table schemas, keys and fixed names shared by every module."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The conformed shot table, in column order. The third item says whether a row
# without the value is acceptable.
# Columns of the shot table.
_SHOT_FIELDS = [
    ("season", T.StringType(), False),
    ("season_type", T.StringType(), False),
    ("player_id", T.LongType(), False),
    ("player_name", T.StringType(), False),
    ("team_id", T.LongType(), True),
    ("team_name", T.StringType(), True),
    ("game_id", T.StringType(), True),
    ("game_event_id", T.LongType(), True),
    ("game_date", T.DateType(), True),
    ("loc_x", T.DoubleType(), False),
    ("loc_y", T.DoubleType(), False),
    ("shot_made_flag", T.IntegerType(), False),
    ("shot_distance", T.DoubleType(), True),
    ("shot_type", T.StringType(), True),
    ("action_type", T.StringType(), True),
    ("shot_zone_basic", T.StringType(), True),
    ("shot_zone_area", T.StringType(), True),
    ("shot_zone_range", T.StringType(), True),
]

SHOT_COLUMNS = [name for name, _, _ in _SHOT_FIELDS]
REQUIRED_COLUMNS = [name for name, _, optional in _SHOT_FIELDS if not optional]

# Two rows agreeing on all of these are the same shot.
# The key of a shot.
SHOT_KEY = [
    "season",
    "season_type",
    "player_id",
    "game_id",
    "game_event_id",
    "loc_x",
    "loc_y",
    "shot_made_flag",
]
# Key columns that may be missing; a row missing one is never a duplicate.
OPTIONAL_KEY = ["game_id", "game_event_id"]

PARTITIONING = ["season", "season_type"]

SHOT_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in _SHOT_FIELDS])
STORED_SHOT_SCHEMA = T.StructType(
    [
        T.StructField("shot_id", T.LongType(), True),
        *SHOT_SCHEMA.fields,
        T.StructField("created_at", T.TimestampType(), True),
    ]
)
PREDICTION_SCHEMA = T.StructType(
    [
        T.StructField("shot_id", T.LongType(), True),
        T.StructField("season", T.StringType(), True),
        T.StructField("season_type", T.StringType(), True),
        T.StructField("player_id", T.LongType(), True),
        T.StructField("game_date", T.DateType(), True),
        T.StructField("predicted_make_prob", T.DoubleType(), True),
        T.StructField("actual_make", T.IntegerType(), True),
        T.StructField("created_at", T.TimestampType(), True),
    ]
)
DRIFT_STRUCT = T.StructType(
    [T.StructField("psi", T.DoubleType()), T.StructField("status", T.StringType())]
)
REPORT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType(), True),
        T.StructField("season", T.StringType(), True),
        T.StructField("season_type", T.StringType(), True),
        T.StructField("brier_score", T.DoubleType(), True),
        T.StructField("ece", T.DoubleType(), True),
        T.StructField("log_loss", T.DoubleType(), True),
        T.StructField("n_predictions", T.LongType(), True),
        T.StructField("drift_report", T.MapType(T.StringType(), DRIFT_STRUCT), True),
        T.StructField("alert_triggered", T.BooleanType(), True),
        T.StructField("alert_message", T.StringType(), True),
        T.StructField("baseline_brier", T.DoubleType(), True),
    ]
)

# Columns of a landed dump and the names they get here.
RAW_COLUMN_NAMES = {
    "GAME_ID": "game_id",
    "GAME_EVENT_ID": "game_event_id",
    "GAME_DATE": "game_date",
    "PLAYER_ID": "player_id",
    "PLAYER_NAME": "player_name",
    "TEAM_ID": "team_id",
    "TEAM_NAME": "team_name",
    "LOC_X": "loc_x",
    "LOC_Y": "loc_y",
    "SHOT_MADE_FLAG": "shot_made_flag",
    "SHOT_DISTANCE": "shot_distance",
    "SHOT_TYPE": "shot_type",
    "ACTION_TYPE": "action_type",
    "SHOT_ZONE_BASIC": "shot_zone_basic",
    "SHOT_ZONE_AREA": "shot_zone_area",
    "SHOT_ZONE_RANGE": "shot_zone_range",
}

# Names the source uses.
REGULAR_SEASON = "Regular Season"
THREE_POINT_TYPE = "3PT Field Goal"
ZONE_CATEGORIES = ["shot_zone_basic", "shot_zone_area", "shot_zone_range"]


def conform(df: DataFrame) -> DataFrame:
    """Give any frame the 18 shot columns, in order and typed.

    Missing columns become null, extra ones are dropped, and NaN in a floating
    column becomes null, so that the result can be appended to the shot table.
    """
    have = dict(df.dtypes)
    out = []
    for field in SHOT_SCHEMA.fields:
        if field.name not in have:
            out.append(F.lit(None).cast(field.dataType).alias(field.name))
            continue
        c = F.col(field.name)
        if have[field.name] in ("double", "float"):
            c = F.nanvl(c, F.lit(None).cast("double"))
        out.append(c.try_cast(field.dataType).alias(field.name))
    return df.select(*out)
