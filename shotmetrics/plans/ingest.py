"""Filling the stored shot table from landed dumps."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.players import players_with_games
from ..schema import PARTITIONING, REGULAR_SEASON
from ..sources.landing import load_player_dump, read_landed, standardize
from ..sources.tables import ShotStore, missing_players, storable

logger = logging.getLogger(__name__)


class NoPlayers(RuntimeError):
    """The landed dump has no player for the season."""


def ensure_player(
    store: ShotStore,
    dump_path: str,
    player_id: int,
    player_name: str,
    season: str,
    season_type: str = REGULAR_SEASON,
    force_refresh: bool = False,
    fmt: str = "json",
) -> DataFrame:
    """A player's stored season, loaded from the dump first when it is missing."""
    store.initialize()
    if force_refresh:
        logger.info("removed %d rows of player %s", store.delete_player(player_id, season, season_type), player_id)
    if not store.has_player(player_id, season, season_type):
        added = store.upsert(load_player_dump(store.spark, dump_path, player_id, player_name, season, season_type, fmt))
        if not added:
            logger.warning("no shots of %s in %s", player_name, season)
    return store.player_shots(player_id, season, season_type)


def season_rows(
    spark: SparkSession, dump_path: str, season: str, season_type: str, fmt: str = "json"
) -> DataFrame:
    """A landed season dump, standardised, with rows of other seasons left out."""
    return standardize(_of_season(read_landed(spark, dump_path, fmt), season, season_type), season, season_type)


def _of_season(raw: DataFrame, season: str, season_type: str) -> DataFrame:
    """Raw rows of the season, and those that name none."""
    for column, value in (("SEASON", season), ("SEASON_TYPE", season_type)):
        if column in raw.columns:
            raw = raw.where(F.col(column).isNull() | (F.col(column) == value))
    return raw


def first_players(
    players: DataFrame, max_players: int | None = None, order: list[str] | None = None
) -> DataFrame:
    """All players, or the first so many by name."""
    if max_players is None:
        return players
    return players.orderBy(*(order or ["player_name", "player_id"])).limit(max_players)


def ensure_season(
    store: ShotStore,
    dump_path: str,
    season: str,
    season_type: str = REGULAR_SEASON,
    force_refresh: bool = False,
    max_players: int | None = None,
    fmt: str = "json",
) -> DataFrame:
    """A stored season, filled from the dump for all players that lack it.

    All players with games in the season are loaded by one join instead of one
    request each. With ``force_refresh`` the stored rows of the chosen players
    are replaced; a player without storable new rows keeps the old ones.
    """
    store.initialize()
    if not force_refresh and store.season_count(season, season_type) > 0:
        return store.season_shots(season, season_type)
    raw = _of_season(read_landed(store.spark, dump_path, fmt), season, season_type)
    players = players_with_games(raw).withColumns({"season": F.lit(season), "season_type": F.lit(season_type)})
    if players.isEmpty():
        raise NoPlayers(f"no players for season={season}, season_type={season_type}")
    rows = standardize(raw, season, season_type)
    chosen = first_players(players, max_players)
    if force_refresh:
        fresh = _of_players(rows, chosen)
        store.replace_players(fresh, storable(fresh).select("player_id").distinct(), season, season_type)
    else:
        store.upsert(_of_players(rows, missing_players(chosen, store.shots())))
    return store.season_shots(season, season_type)


def _of_players(rows: DataFrame, players: DataFrame) -> DataFrame:
    return rows.join(players.select("player_id", *PARTITIONING), ["player_id", *PARTITIONING], "left_semi")
