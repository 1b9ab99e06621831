"""Landed raw dumps to conformed shot rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import lenient_double
from ..schema import RAW_COLUMN_NAMES, SHOT_COLUMNS, SHOT_SCHEMA

# Everything lands as text; numbers are read leniently afterwards.
RAW_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in [*RAW_COLUMN_NAMES, "SEASON", "SEASON_TYPE"]]
)
FORMATS = ("json", "csv", "parquet")
_NUMERIC = ["loc_x", "loc_y", "shot_made_flag", "shot_distance", "game_event_id", "team_id", "player_id"]


def read_landed(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """A dump in JSON lines, CSV with header, or parquet, as it lies there."""
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {FORMATS}")
    reader = spark.read
    if fmt == "parquet":
        return reader.parquet(path)
    if fmt == "csv":
        # by name, not by position: a dump may lack columns or order them otherwise
        return reader.option("header", True).csv(path)
    return reader.schema(RAW_SCHEMA).json(path)


def _date(df: DataFrame) -> Column:
    if dict(df.dtypes).get("game_date") != "string":
        return F.col("game_date").try_cast("date")
    text = F.trim("game_date")
    return F.coalesce(F.try_to_date(text, "yyyy-MM-dd"), F.try_to_date(text, "yyyyMMdd"))


def standardize(
    raw: DataFrame,
    season: str | Column | None = None,
    season_type: str | Column | None = None,
    player_id: int | Column | None = None,
    player_name: str | Column | None = None,
) -> DataFrame:
    """Raw rows to the shot schema.

    Columns are renamed, the four given values (literals or columns) replace
    whatever the dump says, absent columns become null, numbers are read
    leniently and an unreadable made flag counts as a miss.
    """
    given = {"season": season, "season_type": season_type, "player_id": player_id, "player_name": player_name}
    names = {**RAW_COLUMN_NAMES, "SEASON": "season", "SEASON_TYPE": "season_type"}
    fixed = {k: v if isinstance(v, Column) else F.lit(v) for k, v in given.items() if v is not None}
    df = raw.select(*[F.col(c).alias(names.get(c, c)) for c in raw.columns]).withColumns(
        {k: v for k, v in fixed.items()}
    )
    out = []
    for field in SHOT_SCHEMA.fields:
        name = field.name
        if name not in df.columns:
            c = F.lit(None)
        elif name in _NUMERIC:
            c = lenient_double(df, name)
        elif name == "game_date":
            c = _date(df)
        else:
            c = F.col(name)
        if name == "shot_made_flag":
            c = F.coalesce(c, F.lit(0.0))
        out.append(c.try_cast(field.dataType).alias(name))
    return df.select(*out).select(*SHOT_COLUMNS)


def load_player_dump(
    spark: SparkSession, path: str, player_id: int, player_name: str, season: str, season_type: str, fmt: str = "json"
) -> DataFrame:
    """One player's rows of a landed dump for a season, standardised."""
    raw = read_landed(spark, path, fmt)
    here = raw.where(lenient_double(raw, "PLAYER_ID") == player_id)
    for column, value in (("SEASON", season), ("SEASON_TYPE", season_type)):
        if column in raw.columns:
            here = here.where(F.col(column).isNull() | (F.col(column) == value))
    return standardize(here, season, season_type, player_id, player_name)
