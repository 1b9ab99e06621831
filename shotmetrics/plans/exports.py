"""CSV extracts of a scored season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.court import inferred_three
from ..functions.seasons import normalize_season
from ..operators.features import with_made_minus_expected
from ..operators.reports import player_metrics
from ..operators.spatial import with_zone
from ..schema import REGULAR_SEASON, SHOT_COLUMNS
from ..sources.tables import in_season, write_csv


def shot_extract(scored: DataFrame) -> DataFrame:
    """The shot columns with p_make, made_minus_expected, is_3 and zone_id."""
    rows = with_zone(with_made_minus_expected(scored).withColumn("is_3", inferred_three(scored)))
    have = [c if c in rows.columns else F.lit(None).alias(c) for c in SHOT_COLUMNS]
    return rows.select(*have, "p_make", "made_minus_expected", "is_3", "zone_id")


def export_season(scored: DataFrame, out: str, season: int | str, season_type: str = REGULAR_SEASON) -> dict[str, str]:
    """Write a season's shots and player metrics as CSV folders; returns their paths.

    The season may be a label or its start year.
    """
    rows = in_season(scored, normalize_season(season), season_type)
    parts = {"shots": shot_extract(rows), "leaderboard": player_metrics(rows)}
    paths = {name: f"{out}/{name}" for name in parts}
    for name, df in parts.items():
        write_csv(df, paths[name])
    return paths
