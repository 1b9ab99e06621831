"""How well probabilities match outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import PROBABILITY_UNIT, clip, count_at_most, exact_mean, exact_sum, exact_weighted_mean
from .lineage import checkpointed
from .ranking import quantile_steps, quantiles_of_counts


def _log_loss(p: Column, y: Column) -> Column:
    """Per-row log loss; y is 0 or 1, so only one of the two terms counts; null without a label."""
    return F.when(y == 1, -F.log(p)).when(y.isNotNull(), -F.log(F.lit(1.0) - p))


def binary_metrics(df: DataFrame, p: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Log loss and Brier score over labelled rows, probabilities limited to [1e-6, 1-1e-6]."""
    prob = clip(F.col(p), 1e-6, 1 - 1e-6)
    miss = prob - F.col(y)
    return df.groupBy(*(by or [])).agg(
        exact_mean(_log_loss(prob, F.col(y))).alias("log_loss"), exact_mean(miss * miss).alias("brier_score")
    )


def calibration_metrics(df: DataFrame, p: str, y: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """Brier score, expected calibration error and log loss in one pass.

    Rows are first summed per equal-width bin. A bin's weight times its gap,
    (n_b/n) * |mean p - mean y|, is |sum p - sum y| / n, so the error needs
    nothing but the two sums of each bin.
    """
    by = by or []
    known = df.select(
        *by, clip(F.col(p), 1e-7, 1 - 1e-7).alias("_p"), F.col(y).cast("double").alias("_y")
    ).where(F.col("_p").isNotNull() & F.col("_y").isNotNull())
    edges = quantile_steps(bins)[1:-1]
    miss = F.col("_p") - F.col("_y")
    per_bin = known.groupBy(*by, count_at_most(F.col("_p"), edges).alias("bin")).agg(
        F.count(F.lit(1)).alias("_n"),
        exact_sum(miss).alias("_gap"),
        exact_sum(miss * miss).alias("_sq"),
        exact_sum(_log_loss(F.col("_p"), F.col("_y"))).alias("_ll"),
    )
    n = F.sum("_n").cast("double") * F.lit(float(PROBABILITY_UNIT))
    return per_bin.groupBy(*by).agg(
        F.try_divide(F.sum("_sq"), n).alias("brier_score"),
        F.try_divide(F.sum(F.abs("_gap")), n).alias("ece"),
        F.try_divide(F.sum("_ll"), n).alias("log_loss"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_predictions"),
    )


def calibration_curve(df: DataFrame, p: str, y: str, bins: int = 12) -> DataFrame:
    """Mean probability and observed rate per quantile bin, empty bins left out.

    A probability's bin is the number of inner edges strictly below it.
    """
    known = df.select(F.col(p).cast("double").alias("_p"), F.col(y).cast("bigint").alias("_y")).dropna()
    # one pass over the rows; the bins are then formed of counted probabilities
    counted = checkpointed(known.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.sum("_y").alias("_made")))
    edges = quantiles_of_counts(counted, "_p", "_n", quantile_steps(bins)).select("quantiles").scalar()
    below = F.lit(0)
    for i in range(1, bins):
        below = below + (edges[i] < F.col("_p")).cast("int")
    n = F.sum("_n").cast("double")
    return counted.groupBy(below.alias("bin")).agg(
        F.sum("_n").alias("n"),
        exact_weighted_mean(F.col("_p"), F.col("_n")).alias("mean_predicted"),
        (F.sum("_made").cast("double") / n).alias("observed_rate"),
    )
