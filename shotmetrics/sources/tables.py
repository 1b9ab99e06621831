"""The stored shot and prediction tables: parquet partitioned by season and type.

One writer at a time is assumed. Writes append through Spark's commit
protocol, so a job that dies leaves the table as it was.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import checkpointed
from ..schema import (
    OPTIONAL_KEY,
    PARTITIONING,
    PREDICTION_SCHEMA,
    REGULAR_SEASON,
    REPORT_SCHEMA,
    REQUIRED_COLUMNS,
    SHOT_COLUMNS,
    SHOT_KEY,
    STORED_SHOT_SCHEMA,
    conform,
)

GAME_ORDER = ["game_date", "game_id", "game_event_id"]


def storable(incoming: DataFrame) -> DataFrame:
    """The rows in the shape of the shot table, without those that miss a required value."""
    return conform(incoming).dropna(subset=REQUIRED_COLUMNS)


def new_rows(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """The incoming rows an insert-or-ignore would add to the stored ones.

    Rows missing a required value are dropped. Of rows with one key a single
    one is kept, and none if the key is stored. A row whose key is incomplete
    is never a duplicate; such rows bypass both steps, so they cannot pile up
    under one shuffle key.
    """
    rows = storable(incoming)
    complete = F.lit(True)
    for c in OPTIONAL_KEY:
        complete = complete & F.col(c).isNotNull()
    rest = [c for c in SHOT_COLUMNS if c not in SHOT_KEY]
    # the hash leads the key so that sorting compares one number, not strings
    key = ["_hash", *SHOT_KEY]
    digest = F.xxhash64(*SHOT_KEY).alias("_hash")
    # combined before the shuffle, so copies of a row never meet in one task
    single = rows.where(complete).select(digest, "*").groupBy(*key).agg(F.min(F.struct(*rest)).alias("_r"))
    known = stored.where(complete).select(digest, *SHOT_KEY)
    added = single.join(known, key, "left_anti").select(*SHOT_KEY, "_r.*")
    return added.select(*SHOT_COLUMNS).unionByName(rows.where(~complete))


def unscored(shots: DataFrame, predictions: DataFrame) -> DataFrame:
    """Shots without a stored prediction; a season's filter on the result reaches both tables."""
    return shots.join(predictions.select(*PARTITIONING, "shot_id"), [*PARTITIONING, "shot_id"], "left_anti")


def as_predictions(scored: DataFrame) -> DataFrame:
    """Scored shots in the shape of the prediction table, unscorable rows dropped."""
    return scored.select(
        "shot_id",
        "season",
        "season_type",
        "player_id",
        "game_date",
        F.col("p_make").cast("double").alias("predicted_make_prob"),
        F.col("shot_made_flag").cast("int").alias("actual_make"),
    ).dropna(subset=["shot_id", "season", "season_type", "player_id", "predicted_make_prob", "actual_make"])


def in_season(shots: DataFrame, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
    return shots.where((F.col("season") == season) & (F.col("season_type") == season_type))


def player_shots(shots: DataFrame, player_id: int, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
    """One player's season in game order; prunes to one partition."""
    return in_season(shots, season, season_type).where(F.col("player_id") == int(player_id)).orderBy(*GAME_ORDER)


def season_shots(shots: DataFrame, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
    """One season by player and game order; prunes to one partition."""
    return in_season(shots, season, season_type).orderBy("player_id", *GAME_ORDER)


def season_counts(shots: DataFrame) -> DataFrame:
    """Rows per season and type."""
    return shots.groupBy("season", "season_type").agg(F.count(F.lit(1)).alias("n_shots"))


def of_partitions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The stored rows of the seasons and types a batch names, so that other partitions are not read."""
    named = storable(batch).select(*PARTITIONING).distinct().collect()  # seasons times types
    wanted = F.lit(False)
    for row in named:
        wanted = wanted | ((F.col("season") == row["season"]) & (F.col("season_type") == row["season_type"]))
    return stored.where(wanted)


def _with_shots(shots: DataFrame) -> DataFrame:
    """Each stored player, season and type once, so that no player is a hot join key."""
    return shots.select("player_id", *PARTITIONING).distinct()


def present_players(players: DataFrame, shots: DataFrame) -> DataFrame:
    """Players (any frame with player_id, season, season_type) that have stored shots."""
    return players.join(_with_shots(shots), ["player_id", *PARTITIONING], "left_semi")


def missing_players(players: DataFrame, shots: DataFrame) -> DataFrame:
    """Players without stored shots."""
    return players.join(_with_shots(shots), ["player_id", *PARTITIONING], "left_anti")


def write_csv(df: DataFrame, path: str) -> None:
    """Export with a header, one file per task, replacing the folder."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_bucketed(df: DataFrame, name: str, buckets: int) -> None:
    """A catalog copy bucketed and sorted on shot_id.

    Shots and predictions saved with the same number of buckets join on
    shot_id without a shuffle.
    """
    df.write.mode("overwrite").bucketBy(buckets, "shot_id").sortBy("shot_id").saveAsTable(name)


def _remove(spark: SparkSession, uri: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(uri))
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@dataclass(frozen=True)
class ShotStore:
    """Shots, predictions and the monitoring log under one folder."""

    spark: SparkSession
    root: str

    @property
    def shots_path(self) -> str:
        return f"{self.root}/shots"

    @property
    def predictions_path(self) -> str:
        return f"{self.root}/predictions"

    @property
    def log_path(self) -> str:
        return f"{self.root}/model_monitoring_log"

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def initialize(self) -> None:
        """Create the tables that are not there yet; harmless to repeat."""
        tables = [
            (self.shots_path, STORED_SHOT_SCHEMA, PARTITIONING),
            (self.predictions_path, PREDICTION_SCHEMA, PARTITIONING),
            (self.log_path, REPORT_SCHEMA, []),
        ]
        for path, schema, parts in tables:
            if not self._exists(path):
                self.spark.createDataFrame([], schema).write.partitionBy(*parts).parquet(path)

    def shots(self) -> DataFrame:
        return self.spark.read.schema(STORED_SHOT_SCHEMA).parquet(self.shots_path)

    def predictions(self) -> DataFrame:
        return self.spark.read.schema(PREDICTION_SCHEMA).parquet(self.predictions_path)

    def _append(self, df: DataFrame, path: str, first_id: int | None = None) -> int:
        """Append by season partitions, each file sorted by player; returns the rows written.

        Rows are gathered by season first, so that a task does not open a file
        in every partition; a season too large for one task is split. Ids are
        given in the writing task itself: unique across tasks, above all
        stored ones, and fixed once written, also when a task runs twice. The
        batch is written once and then counted by its time stamp, which reads
        one column.
        """
        rows = df.hint("rebalance", *PARTITIONING).sortWithinPartitions(*PARTITIONING, "player_id")
        if first_id is not None:
            rows = rows.withColumn("shot_id", F.monotonically_increasing_id() + F.lit(first_id))
        stamp = F.lit(datetime.now(UTC))
        rows = rows.withColumn("created_at", stamp)
        rows.write.mode("append").partitionBy(*PARTITIONING).parquet(path)
        stored = self.shots() if path == self.shots_path else self.predictions()
        return stored.where(F.col("created_at") == stamp).count()

    def _next_id(self) -> int:
        top = self.shots().agg(F.max("shot_id")).first()[0]
        return 0 if top is None else top + 1

    def upsert(self, frame: DataFrame) -> int:
        """Add the rows not stored yet; returns how many were added."""
        self.initialize()
        stored = of_partitions(self.shots(), frame)
        return self._append(new_rows(frame, stored), self.shots_path, self._next_id())

    def _rewrite(self, season: str, season_type: str, rows: DataFrame) -> None:
        """Make these rows the whole partition of a season and type."""
        rows = checkpointed(rows)
        if rows.isEmpty():
            # an overwrite with no row would leave the old partition in place
            part = in_season(self.shots(), season, season_type)
            folder = F.regexp_replace(F.input_file_name(), "/[^/]*$", "")
            for row in part.select(folder).distinct().collect():
                _remove(self.spark, row[0])
            return
        out = rows.sortWithinPartitions("player_id").write.mode("overwrite")
        out.option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONING).parquet(self.shots_path)

    def delete_player(self, player_id: int, season: str, season_type: str = REGULAR_SEASON) -> int:
        """Remove one player's season by rewriting its partition; returns the rows removed."""
        self.initialize()
        part = in_season(self.shots(), season, season_type)
        mine = F.col("player_id") == int(player_id)
        gone = part.where(mine).count()
        if gone:
            self._rewrite(season, season_type, part.where(~mine))
        return gone

    def replace_players(self, frame: DataFrame, players: DataFrame, season: str, season_type: str) -> None:
        """Put these rows in place of whatever the players have stored in the season."""
        self.initialize()
        part = in_season(self.shots(), season, season_type)
        others = part.join(players.select("player_id").distinct(), "player_id", "left_anti")
        ids = F.monotonically_increasing_id() + F.lit(self._next_id())
        fresh = new_rows(frame, others).withColumns({"shot_id": ids, "created_at": F.current_timestamp()})
        self._rewrite(season, season_type, others.unionByName(fresh))

    def player_shots(self, player_id: int, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
        return player_shots(self.shots(), player_id, season, season_type)

    def season_shots(self, season: str, season_type: str = REGULAR_SEASON) -> DataFrame:
        return season_shots(self.shots(), season, season_type)

    def has_player(self, player_id: int, season: str, season_type: str = REGULAR_SEASON) -> bool:
        rows = in_season(self.shots(), season, season_type).where(F.col("player_id") == int(player_id))
        return not rows.limit(1).isEmpty()

    def season_count(self, season: str, season_type: str = REGULAR_SEASON) -> int:
        return in_season(self.shots(), season, season_type).count()

    def add_predictions(self, scored: DataFrame, all_new: bool = False) -> int:
        """Store predictions of shots that have none yet; returns how many were added.

        ``all_new`` says that the scored shots are known to have none.
        """
        self.initialize()
        rows = as_predictions(scored).dropDuplicates([*PARTITIONING, "shot_id"])
        return self._append(rows if all_new else unscored(rows, self.predictions()), self.predictions_path)
