"""Shots and predictions derived from an order star schema.

A stand-in for real dumps: each order line is a shot of the order's customer
nation (or of the line's supplier, for many players), with place, outcome and
probability computed from the keys in whole numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.seasons import season_label, season_start_year
from ..schema import SHOT_COLUMNS

# the multiplier of the outcome hash, and its modulus
_HASH_FACTOR = 2654435761
_HASH_MOD = 1000003


# part and supplier of a line as one number, the part in front
_PAIR = 10**18
# table schemas already read, so that each query does not open the files again
_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    known = _SCHEMAS.get((spark.sparkContext.applicationId, path))
    if known is not None:
        return spark.read.schema(known).parquet(path)
    df = spark.read.parquet(path)
    _SCHEMAS[spark.sparkContext.applicationId, path] = df.schema
    return df


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (order, line number), by the smallest part and supplier.

    Aggregating before the join keeps an order with very many line copies
    down to one row per line number.
    """
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # a number, unlike a struct, can be compared inside a hash aggregate
    part = F.col("l_partkey").cast("decimal(19,0)") * F.lit(_PAIR).cast("decimal(19,0)")
    pair = (part + F.col("l_suppkey").cast("decimal(18,0)")).cast("decimal(38,0)")
    first = items.groupBy("l_orderkey", "l_linenumber").agg(F.min(pair).alias("f"))
    return first.select(
        "l_orderkey",
        "l_linenumber",
        F.expr(f"cast(f div {_PAIR} as bigint)").alias("l_partkey"),
        F.expr(f"cast(f % {_PAIR} as bigint)").alias("l_suppkey"),
    )


def _orders(spark: SparkSession, sf_dir: str, players: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.col("o_orderdate").cast("date").alias("game_date"), "o_orderstatus"
    )
    if players != "nation":
        return orders.drop("o_custkey")
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    nations = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("player_name")
    )
    named = orders.join(customers, "o_custkey").join(nations, "c_nationkey")
    return named.withColumn("player_id", F.col("c_nationkey").cast("bigint")).drop("o_custkey", "c_nationkey")


def _derived(spark: SparkSession, sf_dir: str, players: str) -> DataFrame:
    rows = _lines(spark, sf_dir).join(_orders(spark, sf_dir, players), "l_orderkey")
    if players == "supplier":
        suppliers = table(spark, sf_dir, "supplier").select(
            F.col("s_suppkey").alias("l_suppkey"), F.col("s_name").alias("player_name")
        )
        rows = rows.join(suppliers, "l_suppkey").withColumn("player_id", F.col("l_suppkey"))
    key, line = F.col("l_orderkey"), F.col("l_linenumber").cast("bigint")
    part, supp = F.col("l_partkey"), F.col("l_suppkey")
    rows = rows.withColumns(
        {
            "shot_id": key * 8 + line,
            "_x": (part * 37 + supp * 11 + key) % 501 - 250,
            "_y": (part * 53 + line * 29 + key * 7) % 331 - 47,
            "_sy": season_start_year(F.col("game_date")),
        }
    )
    r = F.sqrt((F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")).cast("double"))
    rows = rows.withColumns({"_r": r, "_feet": F.floor(r / F.lit(10.0))})
    return rows.withColumn("p4", F.greatest(F.lit(2000).cast("bigint"), F.lit(6500) - F.lit(120) * F.col("_feet")))


def _made():
    # the factor is reduced first so that the product cannot overflow
    mixed = (F.col("shot_id") % _HASH_MOD) * (_HASH_FACTOR % _HASH_MOD) + 12345
    form = ((F.col("player_id") * 7 + F.col("_sy") * 3) % 11 - 5) * 150
    return F.when((mixed % _HASH_MOD) % 10000 < F.col("p4") + form, 1).otherwise(0)


def shots(spark: SparkSession, sf_dir: str, players: str = "nation") -> DataFrame:
    """The shot table: shot_id and the 18 shot columns."""
    x, y, r, feet = F.col("_x"), F.col("_y"), F.col("_r"), F.col("_feet")
    zone = (
        F.when((y <= 92) & (x <= -220), "Left Corner 3")
        .when((y <= 92) & (x >= 220), "Right Corner 3")
        .when(r <= 40, "Restricted Area")
        .when((F.abs(x) <= 80) & (y <= 142), "In The Paint (Non-RA)")
        .when(r < 237.5, "Mid-Range")
        .otherwise("Above the Break 3")
    )
    area = F.when(F.abs(x) <= 80, "Center(C)").when(x < -80, "Left Side(L)").otherwise("Right Side(R)")
    reach = F.when(feet < 8, "Less Than 8 ft.").when(feet < 16, "8-16 ft.").when(feet < 24, "16-24 ft.").otherwise("24+ ft.")
    rows = _derived(spark, sf_dir, players).withColumns(
        {
            "season": season_label(F.col("_sy")),
            "season_type": F.when(F.col("o_orderstatus") == "P", "Playoffs").otherwise("Regular Season"),
            "team_id": F.lit(None).cast("bigint"),
            "team_name": F.lit(None).cast("string"),
            "game_id": F.col("l_orderkey").cast("string"),
            "game_event_id": F.col("l_linenumber").cast("bigint"),
            "loc_x": x.cast("double"),
            "loc_y": y.cast("double"),
            "shot_made_flag": _made(),
            "shot_distance": feet.cast("double"),
            "action_type": F.lit(None).cast("string"),
            "shot_zone_basic": zone,
            "shot_zone_area": F.when(F.col("shot_id") % 97 != 0, area),
            "shot_zone_range": reach,
        }
    )
    three = F.col("shot_zone_basic").contains("3")
    rows = rows.withColumn("shot_type", F.when(three, "3PT Field Goal").otherwise("2PT Field Goal"))
    return rows.select("shot_id", *SHOT_COLUMNS)


def predictions(spark: SparkSession, sf_dir: str, players: str = "nation") -> DataFrame:
    """The prediction table with a closed-form probability."""
    return _derived(spark, sf_dir, players).select(
        "shot_id",
        season_label(F.col("_sy")).alias("season"),
        F.when(F.col("o_orderstatus") == "P", "Playoffs").otherwise("Regular Season").alias("season_type"),
        "player_id",
        "game_date",
        (F.col("p4").cast("double") / F.lit(10000.0)).alias("predicted_make_prob"),
        _made().alias("actual_make"),
    )


def with_closed_form_score(shot_rows: DataFrame) -> DataFrame:
    """Add the closed-form p_make to shots, as a model would."""
    p4 = F.greatest(F.lit(2000.0), F.lit(6500.0) - F.lit(120.0) * F.col("shot_distance"))
    return shot_rows.withColumn("p_make", p4 / F.lit(10000.0))
