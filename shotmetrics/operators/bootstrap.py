"""Row bootstrap as one distributed aggregation.

Resampling n of n rows with replacement gives each row a nearly Poisson(1)
number of copies. Every (row, replicate) pair gets its count from a hash of
the row's key, so replicates need no sampling pass, no driver loop and come
out the same on any cluster. Rows are summed per replicate before the
shuffle, which then moves one row per replicate and task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import exact_weighted_sum, round_half_away, two_sided_p

# one 128-bit digest gives the draws of four replicates
_PER_DIGEST = 4
# cumulative Poisson(1) probabilities up to a count of 12, beyond which a
# 32-bit uniform cannot tell
POISSON_STEPS = [sum(math.exp(-1) / math.factorial(k) for k in range(n + 1)) for n in range(12)]


def replicate_sums(
    df: DataFrame, key: list[str], measures: dict[str, Column], replicates: int = 500, seed: int = 42
) -> DataFrame:
    """Columns replicate and the weighted sum of each measure.

    ``key`` must identify a row. A null measure adds nothing.
    """
    slim = df.select(
        F.concat_ws("|", *[F.col(k).cast("string") for k in key]).alias("_key"),
        *[m.alias(name) for name, m in measures.items()],
    )
    blocks = math.ceil(replicates / _PER_DIGEST)
    # spread first: each row becomes hundreds where it lies
    slim = slim.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key")
    drawn = slim.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    digest = F.md5(F.concat_ws("|", "_key", F.col("_block").cast("string"), F.lit(str(seed))))
    drawn = drawn.withColumn("_digest", digest)
    draws = F.array(
        *[
            F.struct(
                (F.col("_block") * _PER_DIGEST + j).alias("replicate"),
                F.conv(F.substring("_digest", 1 + 8 * j, 8), 16, 10).cast("bigint").alias("hash"),
            )
            for j in range(_PER_DIGEST)
        ]
    )
    rows = drawn.select(*measures, F.explode(draws).alias("_d")).select(
        *measures,
        F.col("_d.replicate").alias("replicate"),
        ((F.col("_d.hash").cast("double") + F.lit(0.5)) / F.lit(4294967296.0)).alias("_u"),
    )
    copies = F.lit(0)
    for step in POISSON_STEPS:
        copies = copies + (F.col("_u") >= F.lit(step)).cast("int")
    rows = rows.withColumn("_copies", copies).where((F.col("_copies") > 0) & (F.col("replicate") < replicates))
    return rows.groupBy("replicate").agg(
        *[exact_weighted_sum(F.col(name), F.col("_copies")).alias(name) for name in measures]
    )


def spread_of(estimates: DataFrame, column: str, at_least: int = 1) -> DataFrame:
    """One row: population SD and 2.5/97.5 percentiles over the usable replicates."""
    usable = estimates.where(F.col(column).isNotNull() & ~F.isnan(column))
    # as many rows as replicates
    row = usable.agg(
        F.count(F.lit(1)).alias("_n"),
        F.stddev_pop(column).alias("se"),
        F.percentile(column, F.lit(0.025)).alias("ci_lower"),
        F.percentile(column, F.lit(0.975)).alias("ci_upper"),
    )
    enough = F.col("_n") >= at_least
    return row.select(*[F.when(enough, F.col(c)).alias(c) for c in ("se", "ci_lower", "ci_upper")])


def with_spread(
    point: DataFrame, estimate: str, spread: DataFrame, digits: int = 5, flat_p: float | None = 1.0
) -> DataFrame:
    """Add se, interval and two-sided p-value to a one-row estimate; round them.

    ``flat_p`` is the p-value of an estimate whose replicates do not differ.
    """
    s = spread.select(F.struct("se", "ci_lower", "ci_upper")).scalar()
    full = point.withColumn("_s", s)
    se = F.col("_s.se")
    p = F.when(se > 0, two_sided_p(F.try_divide(F.col(estimate), se))).when(se == 0, F.lit(flat_p).cast("double"))
    return full.select(
        *[round_half_away(F.col(c), digits).alias(c) if c == estimate else F.col(c) for c in point.columns],
        *[round_half_away(F.col(f"_s.{c}"), digits).alias(c) for c in ("se", "ci_lower", "ci_upper")],
        round_half_away(p, 4).alias("p_value"),
    )
