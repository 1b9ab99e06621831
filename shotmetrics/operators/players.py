"""The player dimension: who played, and which player a typed name means."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import lenient_double

GRAM = 3
SUGGESTIONS = 5
SALTS = 16


def players_with_games(game_log: DataFrame, id_col: str = "PLAYER_ID", name_col: str = "PLAYER_NAME") -> DataFrame:
    """Distinct players of a raw game log; ids that are no number are dropped."""
    pairs = game_log.select(
        lenient_double(game_log, id_col).cast("bigint").alias("player_id"), F.col(name_col).alias("player_name")
    ).where(F.col("player_id").isNotNull())
    return pairs.select("player_id", F.coalesce("player_name", F.lit("Unknown")).alias("player_name")).distinct()


def player_names(players: DataFrame, active_only: bool = False) -> DataFrame:
    """Sorted names, optionally of active players only."""
    rows = players.where(F.col("is_active")) if active_only else players
    return rows.select("full_name").orderBy("full_name")


def _grams(text, size):
    """Distinct substrings of this length."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, size))))


def resolve_names(queries: DataFrame, players: DataFrame, query: str = "query") -> DataFrame:
    """Resolve typed names to ids: exact, then ignoring case, then by unique substring.

    ``players`` has id and full_name. Result: query, status (exact, ci,
    substring, ambiguous, not_found, empty), player_id, candidates (the first
    five matches by name, for an ambiguous one). Of several players with one
    name the highest id is taken. A null or empty query is answered "empty"; a
    blank one occurs in every name.

    Substring search is an equi-join: a query can only occur in names that
    hold its rarest three-letter piece (or shorter, for short queries), so
    only those are compared, and per query at most five names survive each
    task.
    """
    asked = queries.select(F.col(query).alias("query")).distinct()
    asked = asked.withColumn("needle", F.trim(F.lower("query")))
    names = players.groupBy("full_name").agg(F.max("id").alias("id"))
    names = names.withColumn("lowered", F.lower("full_name"))

    exact = names.select(F.col("full_name").alias("query"), F.col("id").alias("exact_id"))
    # of names differing in case only, the last by name wins
    folded = names.groupBy("lowered").agg(F.max_by("id", "full_name").alias("ci_id"))
    tried = asked.join(exact, "query", "left").join(
        folded.withColumnRenamed("lowered", "needle"), "needle", "left"
    )
    open_ = tried.where(F.col("exact_id").isNull() & F.col("ci_id").isNull() & (F.col("needle") != ""))
    needles = open_.select("needle").distinct()

    sized = needles.withColumn("size", F.least(F.length("needle"), F.lit(GRAM)))
    pieces = sized.select("needle", "size", F.explode(_grams(F.col("needle"), F.col("size"))).alias("gram"))
    wanted = pieces.select("size", "gram").distinct()
    sizes = F.explode(F.sequence(F.lit(1), F.lit(GRAM))).alias("size")
    held = names.select("full_name", "lowered", "id", sizes)
    held = held.select("full_name", "lowered", "id", "size", F.explode(_grams(F.col("lowered"), F.col("size"))).alias("gram"))
    held = held.join(wanted, ["size", "gram"], "left_semi")

    spread = held.groupBy("size", "gram").agg(F.count(F.lit(1)).alias("names"))
    # a piece no name holds settles the query: it occurs nowhere
    rarity = pieces.join(spread, ["size", "gram"], "left")
    chosen = rarity.groupBy("needle").agg(
        F.min_by(F.struct("size", "gram"), F.struct(F.coalesce("names", F.lit(0)).alias("n"), F.col("gram"))).alias("p")
    ).select("needle", "p.size", "p.gram")
    # a piece of one letter is in a large share of all names, so its names are dealt over several tasks
    salted = chosen.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("full_name"), F.lit(SALTS)).cast("int"))
    hits = salted.join(dealt, ["size", "gram", "salt"]).where(F.col("lowered").contains(F.col("needle")))
    order = Window.partitionBy("needle").orderBy("full_name")
    firsts = hits.select("needle", "full_name", "id", F.row_number().over(order).alias("place")).where(
        F.col("place") <= SUGGESTIONS
    )
    found = firsts.groupBy("needle").agg(
        F.count(F.lit(1)).alias("matches"),
        F.max("id").alias("sub_id"),
        F.array_sort(F.collect_list("full_name")).alias("names"),
    )
    full = tried.join(found, "needle", "left")
    some = names.orderBy("full_name").limit(SUGGESTIONS).agg(
        F.count(F.lit(1)).alias("some"), F.max("id").alias("some_id"), F.array_sort(F.collect_list("full_name")).alias("some_names")
    )
    # one row; asked only for blank queries
    blank = F.col("needle") == ""
    full = full.crossJoin(F.broadcast(some)).withColumns(
        {
            "matches": F.when(blank, F.col("some")).otherwise(F.col("matches")),
            "sub_id": F.when(blank, F.col("some_id")).otherwise(F.col("sub_id")),
            "names": F.when(blank, F.col("some_names")).otherwise(F.col("names")),
        }
    )
    status = (
        F.when(F.col("query").isNull() | (F.col("query") == ""), "empty")
        .when(F.col("exact_id").isNotNull(), "exact")
        .when(F.col("ci_id").isNotNull(), "ci")
        .when(F.col("matches") == 1, "substring")
        .when(F.col("matches") > 1, "ambiguous")
        .otherwise("not_found")
    )
    unique = F.when((F.col("matches") == 1) & (status == "substring"), F.col("sub_id"))
    return full.select(
        "query",
        status.alias("status"),
        F.coalesce("exact_id", "ci_id", unique).alias("player_id"),
        F.when(status == "ambiguous", F.array_join("names", ", ")).alias("candidates"),
    )
