"""Season labels: a season starts in September and is named after both its years."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST_START_YEAR = 1996
FIRST_MONTH = 9
DEFAULT_SEASON = "2025-26"


def season_start_year(day: Column) -> Column:
    return F.when(F.month(day) >= FIRST_MONTH, F.year(day)).otherwise(F.year(day) - 1)


def season_label(start_year: Column) -> Column:
    """1999 -> '1999-00'."""
    end = F.lpad(F.pmod(start_year + 1, F.lit(100)).cast("string"), 2, "0")
    return F.concat(start_year.cast("string"), F.lit("-"), end)


def season_of(day: Column) -> Column:
    """Label of the season a date falls in; null for a null date."""
    return F.when(day.isNotNull(), season_label(season_start_year(day)))


def normalize_season(value: int | str) -> str:
    """Accept a start year (2025, '2025') or a label ('2025-26'); give the label."""
    year = int(str(value)[:4])
    return f"{year}-{(year + 1) % 100:02d}"


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def season_options(latest: DataFrame, default: str = DEFAULT_SEASON) -> DataFrame:
    """Every season from the first supported one to that of the latest date.

    ``latest`` has one row with one date column. The default season is the
    given one when it is on offer, else the last.
    """
    day = F.col(latest.columns[0])
    last = season_start_year(day)
    years = F.when(last >= FIRST_START_YEAR, F.sequence(F.lit(FIRST_START_YEAR), last))
    seasons = latest.select(last.alias("_last"), F.explode(years).alias("start_year"))
    on_offer = (F.lit(int(default[:4])) >= FIRST_START_YEAR) & (F.lit(int(default[:4])) <= F.col("_last"))
    chosen = F.when(on_offer, F.lit(int(default[:4]))).otherwise(F.col("_last"))
    return seasons.select(
        "start_year",
        season_label(F.col("start_year")).alias("season"),
        (F.col("start_year") == chosen).alias("is_default"),
    )


def season_options_on(spark: SparkSession, today: date | None = None) -> DataFrame:
    """Season options as of a day (default: today)."""
    day = F.current_date() if today is None else F.lit(today)
    return season_options(spark.range(1).select(day.cast("date").alias("today"))).orderBy("start_year")
