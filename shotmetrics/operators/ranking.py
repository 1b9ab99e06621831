"""Order statistics over whole tables without a single-task sort.

Ranks, quantiles and rank sums all need "how many rows lie below this value".
Here equal values are first collapsed to one counted row each (so a value held
by a third of the table costs one row), the counted values are split into
ranges of about equal size, and a running total inside each range is added to
the total of the ranges below it. No task holds more than one range and
nothing comes to the driver but a count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import without_nan
from .lineage import checkpointed

LEAST_RANGES = 32
VALUES_PER_RANGE = 200_000


def running_totals(
    counted: DataFrame, value: str, totals: list[str], by: list[str] | None = None, ranges: int | None = None
) -> DataFrame:
    """Add, per total, what lies strictly below the row's value and in all.

    ``counted`` has one row per (by, value) and is read several times, so it
    should be checkpointed. The bounds of the ranges are a table with a row per
    group of ``by``; without ``ranges`` there is one for every 200,000 values.
    """
    by = by or []
    if ranges is None:
        ranges = max(LEAST_RANGES, -(-counted.count() // VALUES_PER_RANGE))
    steps = [i / ranges for i in range(1, ranges)]
    keys = [F.col(c).alias(f"_k_{c}") for c in by]
    fitted = counted.groupBy(*by).agg(F.percentile_approx(value, steps, max(1000, 10 * ranges)).alias("_edges"))
    bounds = fitted.select(*keys, F.array_distinct("_edges").alias("_edges"))

    def matched(left: DataFrame, right: DataFrame, same: Column) -> DataFrame:
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        return left.join(right, same)

    # without groups one row of bounds
    placed = matched(counted, bounds if by else F.broadcast(bounds), F.lit(True)).drop(*[f"_k_{c}" for c in by])
    placed = placed.withColumn("_range", F.size(F.filter("_edges", lambda e: e <= F.col(value)))).drop("_edges")

    per_range = placed.groupBy(*by, "_range").agg(*[F.sum(t).alias(f"_sum_{t}") for t in totals])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    below = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select(
        *keys,
        F.col("_range").alias("_k_range"),
        *[F.coalesce(F.sum(f"_sum_{t}").over(below), F.lit(0)).alias(f"_offset_{t}") for t in totals],
        *[F.sum(f"_sum_{t}").over(group).alias(f"all_{t}") for t in totals],
    )
    joined = matched(placed, offsets, F.col("_range") == F.col("_k_range"))
    inner = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *counted.columns,
        *[
            (F.coalesce(F.sum(t).over(inner), F.lit(0)) + F.col(f"_offset_{t}")).alias(f"before_{t}")
            for t in totals
        ],
        *[F.col(f"all_{t}") for t in totals],
    )


def _interpolated(low: Column, high: Column, t: Column) -> Column:
    # measured from the nearer end, so that the ends come out exactly
    span = high - low
    return F.when(t >= 0.5, high - span * (F.lit(1.0) - t)).otherwise(low + span * t)


def quantiles_of_counts(
    counted: DataFrame, value: str, count: str, probs: list[float], by: list[str] | None = None
) -> DataFrame:
    """Linearly interpolated quantiles of counted values: by..., quantiles (array), n.

    ``counted`` as for ``running_totals``; rows counted 0 are left out.
    """
    by = by or []
    present = counted.where(F.col(count) > 0).select(*by, F.col(value).alias("_v"), F.col(count).alias("_n"))
    placed = running_totals(present, "_v", ["_n"], by)
    first, last = F.col("before__n"), F.col("before__n") + F.col("_n") - 1
    picks = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("all__n") - 1).cast("double")
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            picks.append(F.max(F.when((index >= first) & (index <= last), F.col("_v"))).alias(f"{side}{i}"))
    found = placed.groupBy(*by).agg(F.max("all__n").alias("n"), *picks)
    out = []
    for i, q in enumerate(probs):
        at = F.lit(float(q)) * (F.col("n") - 1).cast("double")
        out.append(_interpolated(F.col(f"lo{i}"), F.col(f"hi{i}"), at - F.floor(at)))
    # a global aggregate of nothing is a row without values
    return found.where(F.col("n").isNotNull()).select(*by, F.array(*out).alias("quantiles"), "n")


def exact_quantiles(df: DataFrame, value: str, probs: list[float], by: list[str] | None = None) -> DataFrame:
    """``quantiles_of_counts`` of a column; null and NaN values are left out."""
    by = by or []
    known = df.select(*by, without_nan(F.col(value).cast("double")).alias("_v")).where(F.col("_v").isNotNull())
    counted = checkpointed(known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")))
    return quantiles_of_counts(counted, "_v", "_n", probs, by)


def scored_positions(df: DataFrame, score: str, id_col: str, ties: list[str], tiles: int, spread: int = 64) -> DataFrame:
    """Add 1-based rank (ties share) and tile number by descending score.

    For a score with a bounded set of values, such as a share rounded to four
    digits. Rows of equal score are told apart by ``id_col % spread``, then
    the ``ties`` columns; each such cell is numbered on its own and shifted by
    the counts of the cells above it.
    """
    # read for the counts and for the rows
    df = checkpointed(df)
    keyed = df.withColumn("_cell", F.pmod(F.col(id_col), F.lit(spread)))
    cells = keyed.groupBy(score, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    # bounded: possible scores times spread
    everything = Window.partitionBy(F.lit(0))
    above = everything.orderBy(F.col(score).desc(), "_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(
        F.col(score).alias("_score"),
        F.col("_cell").alias("_at"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"),
        F.sum("_n").over(everything).alias("_all"),
    ).withColumn("_first", F.min("_above").over(Window.partitionBy("_score")))
    inside = Window.partitionBy(score, "_cell").orderBy(*ties)
    numbered = keyed.withColumn("_row", F.row_number().over(inside))
    placed = numbered.join(cells, (F.col(score) == F.col("_score")) & (F.col("_cell") == F.col("_at")))
    return placed.select(
        *df.columns,
        (F.col("_first") + 1).alias("position_rank"),
        ntile_of(F.col("_above") + F.col("_row"), F.col("_all"), tiles).alias("tile"),
    )


def ntile_of(position: Column, total: Column, tiles: int) -> Column:
    """NTILE from a 1-based position: the first (total % tiles) tiles hold one more row."""
    small = F.floor(total / tiles)
    larger = F.pmod(total, F.lit(tiles))
    in_larger = larger * (small + 1)
    return (
        F.when(position <= in_larger, F.floor((position - 1) / (small + 1)) + 1)
        .otherwise(larger + F.floor(F.try_divide(position - 1 - in_larger, small)) + 1)
        .cast("int")
    )


def quantile_steps(bins: int) -> list[float]:
    """0, 1/bins, ..., 1 as equal steps from 0; the last is exactly 1."""
    step = 1.0 / bins
    return [i * step for i in range(bins)] + [1.0]
