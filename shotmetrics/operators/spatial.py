"""Where shots come from and how they fall: zones, hexagons, location buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import court
from ..functions.numeric import exact_mean, lenient_double, mean_int, rounded

# Colour limits and thresholds of the standard maps.
QUALITY_LIMITS = (0.2, 0.8)
SMOE_LIMITS = (-0.25, 0.25)
MAP_PRESETS = {
    "frequency": {"value": None, "min_attempts": 1},
    "quality": {"value": "p_make", "min_attempts": 6},
    "smoe": {"value": "made_minus_expected", "min_attempts": 6},
}


def located(shots: DataFrame) -> DataFrame:
    """The shots with plot_x and plot_y, null where a coordinate is no number."""
    return shots.withColumns({"plot_x": lenient_double(shots, "loc_x"), "plot_y": lenient_double(shots, "loc_y")})


def with_zone(shots: DataFrame) -> DataFrame:
    """Add the court zone: null outside the half court or without coordinates."""
    placed = located(shots)
    x, y = F.col("plot_x"), F.col("plot_y")
    measured = placed.withColumns({"_r": court.radius(x, y), "_theta": court.floor_angle(x, y)})
    zone = court.zone_id(x, y, F.col("_r"), F.col("_theta"))
    return measured.withColumn("zone_id", zone).drop("plot_x", "plot_y", "_r", "_theta")


# Rows that fall in no cell are grouped under null and dropped by their count
# afterwards: a filter on the cell itself would be pushed to the scan and
# compute the cell a second time.


def zone_values(
    shots: DataFrame, value: str | None = None, min_attempts: int = 1, by: list[str] | None = None
) -> DataFrame:
    """Per zone: attempts and the value, which is attempts or the mean of a column.

    With a column, a zone counts when all its shots reach ``min_attempts`` and
    at least one of them has the value.
    """
    by = by or []
    zoned = with_zone(shots)
    attempts = F.count("zone_id").alias("attempts")
    if value is None:
        counted = zoned.groupBy(*by, "zone_id").agg(attempts).where(F.col("attempts") > 0)
        return counted.withColumn("value", F.col("attempts").cast("double"))
    v = lenient_double(zoned, value)
    means = zoned.groupBy(*by, "zone_id").agg(attempts, exact_mean(v).alias("value"))
    return means.where((F.col("attempts") >= max(min_attempts, 1)) & F.col("value").isNotNull())


def zone_map(shots: DataFrame, kind: str, by: list[str] | None = None) -> DataFrame:
    """A standard zone map: 'frequency', 'quality' or 'smoe'."""
    return zone_values(shots, by=by, **MAP_PRESETS[kind])


def every_zone(values: DataFrame, by: list[str] | None = None) -> DataFrame:
    """All 14 zones per group, with null where the map has no value.

    A group's zones, 14 at most, are gathered in one row and looked up by
    name, so the map is neither computed twice nor joined with itself.
    """
    by = by or []
    rest = [c for c in values.columns if c not in by and c != "zone_id"]
    entry = F.struct("zone_id", F.struct(*rest).alias("_v"))
    gathered = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(entry)).alias("_zones"))
    names = F.array(*[F.lit(z) for z in court.ZONE_NAMES])
    spread = gathered.select(*by, "_zones", F.explode(names).alias("zone_id"))
    found = spread.withColumn("_v", F.try_element_at("_zones", F.col("zone_id")))
    return found.select(*by, "zone_id", *[F.col(f"_v.{c}").alias(c) for c in rest])


def value_range(
    values: DataFrame,
    value: str = "value",
    center_zero: bool = False,
    low: float | None = None,
    high: float | None = None,
) -> DataFrame:
    """One row (vmin, vmax): the colour limits for a map; given limits win."""
    span = values.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).where(F.col("_lo").isNotNull())
    if center_zero:
        reach = F.greatest(F.abs("_lo"), F.abs("_hi"), F.lit(1e-6))
        vmin, vmax = -reach, reach
    else:
        vmin, vmax = F.col("_lo"), F.col("_hi")
    vmin = vmin if low is None else F.lit(float(low))
    vmax = vmax if high is None else F.lit(float(high))
    if not center_zero:
        close = F.abs(vmin - vmax) <= F.lit(1e-8) + F.lit(1e-5) * F.abs(vmax)
        vmax = F.when(close, vmin + F.lit(1e-6)).otherwise(vmax)
    return span.select(vmin.alias("vmin"), vmax.alias("vmax"))


def hex_map(shots: DataFrame, value: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Per hexagon: attempts, or the mean of a column over the shots that have it."""
    by = by or []
    typed = shots.withColumns({"_x": lenient_double(shots, "loc_x"), "_y": lenient_double(shots, "loc_y")})
    placed = court.with_hex_cell(typed, F.col("_x"), F.col("_y"))
    key = ["lattice", "i", "j"]
    if value is None:
        cells = placed.groupBy(*by, *key).agg(F.count("lattice").alias("attempts"))
        cells = cells.where(F.col("attempts") > 0)
    else:
        placed = placed.withColumn("_v", lenient_double(placed, value))
        cells = placed.groupBy(*by, *key).agg(
            F.count("lattice").alias("_placed"), F.count("_v").alias("attempts"), exact_mean(F.col("_v")).alias("value")
        )
        cells = cells.where((F.col("_placed") > 0) & (F.col("attempts") > 0)).drop("_placed")
    x, y = court.hex_center(F.col("lattice"), F.col("i"), F.col("j"))
    return cells.withColumns({"hex_x": x, "hex_y": y})


def with_location_buckets(scored: DataFrame) -> DataFrame:
    """Complete rows with their distance bucket, angle bucket and made minus expected."""
    typed = scored.withColumns(
        {
            c: lenient_double(scored, c)
            for c in ("loc_x", "loc_y", "shot_distance", "shot_made_flag", "p_make")
        }
    ).dropna(subset=["loc_x", "loc_y", "shot_made_flag", "p_make"])
    x, y = F.col("loc_x"), F.col("loc_y")
    feet = F.coalesce(F.col("shot_distance"), court.radius(x, y) / F.lit(10.0))
    measured = typed.withColumns({"_feet": feet, "_degrees": F.degrees(F.atan2(y, x))})
    return measured.withColumns(
        {
            "distance_bucket": court.distance_bucket(F.col("_feet")),
            "angle_bucket": court.angle_bucket(F.col("_degrees")),
            "made_minus_expected": F.col("shot_made_flag") - F.col("p_make"),
        }
    ).drop("_feet", "_degrees")


def _label_pairs(spark) -> DataFrame:
    """The 35 pairs of distance and angle label."""
    pairs = [(d, a) for d in court.DISTANCE_LABELS for a in court.ANGLE_LABELS]
    return spark.createDataFrame(pairs, "distance_bucket string, angle_bucket string")


def location_buckets(scored: DataFrame, min_attempts: int = 15) -> DataFrame:
    """Attempts, FG, expected FG and SMOE (all x100) per location bucket.

    Every distance and angle pair is present before the attempts filter, the
    empty ones with 0 attempts.
    """
    key = ["distance_bucket", "angle_bucket"]
    in_both = F.col("distance_bucket").isNotNull() & F.col("angle_bucket").isNotNull()
    found = with_location_buckets(scored).groupBy(*key).agg(
        F.count_if(in_both).alias("_n"),
        mean_int(F.col("shot_made_flag")).alias("_fg"),
        exact_mean(F.col("p_make")).alias("_xfg"),
    ).where(F.col("_n") > 0)
    # united rather than joined: a join would test the buckets for null at the scan
    full = _label_pairs(scored.sparkSession).unionByName(found, allowMissingColumns=True)
    full = full.groupBy(*key).agg(*[F.max(c).alias(c) for c in ("_n", "_fg", "_xfg")])
    hundred = F.lit(100.0)
    return full.select(
        "distance_bucket",
        "angle_bucket",
        F.concat_ws(" | ", "distance_bucket", "angle_bucket").alias("location"),
        F.coalesce(F.col("_n"), F.lit(0)).alias("attempts"),
        (F.col("_fg") * hundred).alias("fg_pct"),
        (F.col("_xfg") * hundred).alias("xfg_pct"),
        ((F.col("_fg") - F.col("_xfg")) * hundred).alias("smoe"),
    ).where(F.col("attempts") >= min_attempts)


def best_and_worst(buckets: DataFrame, n: int = 5, round_output: bool = True) -> DataFrame:
    """The n best and n worst buckets by SMOE; a bucket may be in both."""

    def top(order: list, segment: str) -> DataFrame:
        return buckets.orderBy(*order, "location").limit(n).withColumn("segment", F.lit(segment))

    best = top([F.col("smoe").desc_nulls_last()], "Best Spots")
    worst = top([F.col("smoe").asc_nulls_last()], "Worst Spots")
    table = best.unionByName(worst).select("segment", "location", "attempts", "fg_pct", "xfg_pct", "smoe")
    return rounded(table, {"fg_pct": 1, "xfg_pct": 1, "smoe": 1}) if round_output else table
